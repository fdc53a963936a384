import datetime as dt

from pyspark.sql import functions as F

from webloom.functions.blocks import classify_block, is_retryable
from pyspark.sql import functions as F

from webloom.operators.fetchlog import burst_exceeded, cooling_down, latest_fresh, request_rate


def test_retry_statuses(spark):
    df = spark.createDataFrame([(429, None), (404, None), (500, None), (None, "TimeoutError")],
                               "status int, err string")
    assert [r[0] for r in df.select(is_retryable(F.col("status"), F.col("err"))).collect()] == [True, False, True, True]


def test_block_classifier(spark):
    df = spark.createDataFrame([('<div class="g-recaptcha"></div>', 200), ("<p>plain</p>", 200),
                                ("<p>ok</p>", 429), ("Too many requests", 503)], "html string, status int")
    out = [r[0] for r in df.select(classify_block(F.col("status"), F.col("html"))).collect()]
    assert (out[0].type, out[0].requires_action, out[0].confidence) == ("captcha", True, "high")
    assert (out[1].type, out[1].requires_action) == ("none", False)
    assert (out[2].type, out[2].confidence) == ("rate_limited", "high")
    assert (out[3].type, out[3].is_blocked, out[3].confidence) == ("rate_limited", True, "medium")


def _log(spark, oks, start=0, step=1):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("h", base + dt.timedelta(seconds=start + i * step), ok, 200 if ok else 429)
                                  for i, ok in enumerate(oks)], "host string, ts timestamp, ok boolean, status_code int")


def test_rates(spark):
    log = _log(spark, [True] * 4, step=20)
    r = [x.requests_in_window for x in request_rate(log, seconds=60).orderBy("ts").collect()]
    assert r == [1, 2, 3, 3]
    b = [x.burst_exceeded for x in burst_exceeded(log, burst_size=2, seconds=30).orderBy("ts").collect()]
    assert b == [False, True, True, True]


def test_rates_against_counting(spark):
    import random
    rng = random.Random(1)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, f"h{i % 2}", base + dt.timedelta(seconds=rng.randint(0, 400))) for i in range(300)]
    got = {r.i: r.requests_in_window for r in request_rate(spark.createDataFrame(rows, "i long, host string, ts timestamp"), seconds=37).collect()}
    assert got == {i: sum(g == h and dt.timedelta(0) <= t - u < dt.timedelta(seconds=37) for _, g, u in rows) for i, h, t in rows}


def test_failure_runs_against_a_loop(spark):
    import random
    rng = random.Random(2)
    base = dt.datetime(2024, 1, 1)
    rows, t = [], {"u": 0, "v": 0}
    for i in range(600):
        u = rng.choice("uv")
        t[u] += rng.choice([0, 1, 5, 50, 299, 300, 301, 2000])
        rows.append((i, u, base + dt.timedelta(seconds=t[u]), rng.random() < 0.8))
    want, state = {}, {}
    for i, u, at, failed in sorted(rows, key=lambda r: (r[2], r[0])):
        count, last = state.get(u, (0, None))
        fresh = last is not None and (at - last).total_seconds() < 300
        skip = count >= 3 and fresh
        if count >= 3 and not fresh:
            count = 0
        count = count + 1 if failed else 0
        state[u] = (count, at if failed else None)
        want[i] = (skip, count)
    log = spark.createDataFrame(rows, "i long, url string, ts timestamp, failed boolean")
    for bucket in (100, 86_400):
        out = cooling_down(log, threshold=3, cooldown_s=300, tie="i", bucket_s=bucket)
        assert {r.i: (r.skip_direct, r.failures) for r in out.collect()} == want


def test_latest_row_of_equal_times_is_the_largest(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("h", 1, t), ("h", 3, t), ("h", 2, t), ("g", 9, t - dt.timedelta(days=9))], "host string, n int, ts timestamp")
    got = {r.host: (r.n, r.fresh) for r in latest_fresh(df, "host", "ts", "2024-01-01 00:01:00", 300).collect()}
    assert got == {"h": (3, True), "g": (9, False)}


def test_a_run_of_100_000_segments(spark):
    """One URL that fails every 400 s: a count that reaches the threshold begins anew after each pause."""
    n = 100_000
    log = spark.range(n).select(F.col("id").alias("i"), F.lit("u").alias("url"), F.timestamp_seconds(F.col("id") * 400).alias("ts"),
                                F.lit(True).alias("failed"))
    out = cooling_down(log, threshold=3, cooldown_s=300)
    wrong = out.where((F.col("failures") != F.col("i") % 3 + 1) | F.col("skip_direct"))
    assert wrong.count() == 0 and out.count() == n
