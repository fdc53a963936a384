"""Fetch-log measures: request rates (W2, W3), failure runs with cooldown (W4), latest fresh status.

A fetch log is ``(host, url, ts TIMESTAMP, status_code, ...)``. All measures are native. A key that holds a third of
all rows is split by time: rates look back one window length, so rows are dealt by (key, window-long bucket) with a
copy in the next bucket; running numbers of W4 are counted inside time buckets and carried over by bucket totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import materialize


def _us(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def request_rate(log: DataFrame, key: str = "host", ts: str = "ts", seconds: int = 60, name: str = "requests_in_window") -> DataFrame:
    """Requests in the trailing window (strictly newer than ts - seconds) per key."""
    size = seconds * 1_000_000
    bucket = F.floor(_us(ts) / size).cast("long")
    placed = log.withColumn("_at", F.explode(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")),
                                                     F.struct((bucket + 1).alias("b"), F.lit(False).alias("own")))))
    w = Window.partitionBy(key, "_at.b").orderBy(_us(ts)).rangeBetween(-size + 1, 0)
    return placed.withColumn(name, F.count(F.lit(1)).over(w)).where("_at.own").drop("_at")


def burst_exceeded(log: DataFrame, key: str = "host", ts: str = "ts", burst_size: int = 1, seconds: int = 1) -> DataFrame:
    """Count inside the burst window >= burst size."""
    return request_rate(log, key, ts, seconds, "burst_count").withColumn("burst_exceeded", F.col("burst_count") >= burst_size)


def latest_fresh(df: DataFrame, key: str, ts: str, now, max_age_s: int = 300) -> DataFrame:
    """Latest row per key (``max_by``, a partial aggregate; at equal times the largest row) and whether it is at
    most ``max_age_s`` old at ``now``."""
    cols = [c for c in df.columns if c != key]
    row = F.struct(*cols)
    latest = df.groupBy(key).agg(F.max_by(row, F.struct(ts, row)).alias("_l")).select(key, "_l.*")
    now_c = F.lit(now).cast("timestamp") if not isinstance(now, Column) else now
    return latest.withColumn("fresh", (F.unix_micros(now_c) - _us(ts)) <= max_age_s * 1_000_000)


# ----------------------------------------------------------------------------- failure runs

def _carried(df: DataFrame, key: str, order: list[str], bucket: str, sums: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    """Running sums up to each row (itself included) and values of the row before, over (key, order): inside a time
    bucket by a window, across buckets by totals, of which there is one row a key and bucket."""
    inside = Window.partitionBy(key, bucket).orderBy(*order)
    until = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.select("*", *[v.alias(f"_v_{n}") for n, v in sums.items()], *[v.alias(f"_l_{n}") for n, v in lasts.items()])
    totals = df.groupBy(key, bucket).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
                                         *[F.max_by(F.struct(f"_l_{n}"), F.struct(*order)).alias(f"_e_{n}") for n in lasts])
    over = Window.partitionBy(key).orderBy(bucket)
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(key, bucket, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums],
                          *[F.lag(f"_e_{n}").over(over)[f"_l_{n}"].alias(f"_p_{n}") for n in lasts])
    first = F.row_number().over(inside) == 1
    joined = df.withColumn("_first", first)
    for n in sums:
        joined = joined.withColumn(f"_v_{n}", F.sum(f"_v_{n}").over(until))
    for n in lasts:
        joined = joined.withColumn(f"_l_{n}", F.lag(f"_l_{n}").over(inside))
    joined = joined.join(carry, [key, bucket])
    keep = [c for c in df.columns if not c.startswith(("_v_", "_l_"))]
    return joined.select(*keep, *[(F.col(f"_v_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums],
                         *[F.when(F.col("_first"), F.col(f"_p_{n}")).otherwise(F.col(f"_l_{n}")).alias(n) for n in lasts])


def cooling_down(log: DataFrame, key: str = "url", ts: str = "ts", failed: str = "failed", threshold: int = 3,
                 cooldown_s: float = 300.0, tie: str | None = None, bucket_s: int = 86_400) -> DataFrame:
    """Per md5(url): whether the direct path would be skipped when a row's request arrives (failures since the last
    success >= threshold and the last failure newer than the cooldown; past the cooldown a count that has reached the
    threshold begins anew), then the count after the row's own outcome.

    Gaps and islands: a run is the rows after a success up to the next one, a segment of it is parted from the one
    before by a pause of at least the cooldown. Only a pause can end a count, so a segment of n failures takes a count below
    the threshold, at its begin, to ``count + n``, or to 0 where that has reached the threshold at the next pause: a function
    of ``threshold`` states. These functions are composed over the segments of a time bucket, then over buckets, then
    over groups of buckets, and each segment's count at its begin is read off; every list has a bounded length, and the
    work is linear in the segments. ``tie`` orders rows of equal time."""
    from webloom.functions.text import url_key
    if threshold < 1:
        raise ValueError("threshold must be at least 1")
    order = ["_us", *([tie] if tie else [])]
    base = (log.withColumn("url_key", url_key(F.col(key))).withColumn("_us", _us(ts))
            .withColumn("_b", F.floor(F.col("_us") / (bucket_s * 1_000_000)).cast("long")).withColumn("_f", F.coalesce(F.col(failed), F.lit(False))))
    one = _carried(base, "url_key", order, "_b", {"_n": F.lit(1), "_ok": (~F.col("_f")).cast("long")}, {"_before": F.struct("_us", "_f")})
    pause = F.col("_before").isNotNull() & F.col("_before._f") & (F.col("_us") - F.col("_before._us") >= int(cooldown_s * 1_000_000))
    two = one.withColumn("_run", F.col("_ok") - (~F.col("_f")).cast("long")).withColumn("_pause", pause.cast("long"))
    rows = materialize(_carried(two, "url_key", order, "_b", {"_seg": F.col("_pause")}, {}), "failure-rows")
    states = F.sequence(F.lit(0), F.lit(threshold - 1))
    sizes = materialize(rows.groupBy("url_key", "_run", "_seg").agg(F.count_if("_f").alias("_size"), F.min("_n").alias("_from"), F.min("_b").alias("_at"))
             .withColumn("_fn", F.transform(states, lambda s: F.when(s + F.col("_size") >= threshold, 0).otherwise((s + F.col("_size")).cast("int"))))
             .withColumn("_far", F.floor(F.col("_at") / BUCKETS).cast("long")), "failure-segments")
    run = ["url_key", "_run"]
    near, buckets = _composed(sizes, [*run, "_far", "_at"], "_seg", threshold)
    wide, groups = _composed(buckets, [*run, "_far"], "_at", threshold)
    top, _ = _composed(groups, run, "_far", threshold)
    begun = (near.join(wide.select(*run, "_far", "_at", F.col("_in").alias("_in2")), [*run, "_far", "_at"])
             .join(top.select(*run, "_far", F.col("_in").alias("_in3")), [*run, "_far"]))
    entry = F.get("_in", F.get("_in2", F.get("_in3", F.lit(0))))  # a run begins with 0
    begun = begun.select(*run, "_seg", entry.cast("long").alias("_begun")).join(sizes.select(*run, "_seg", "_from"), [*run, "_seg"])
    count = F.col("_begun") + F.col("_n") - F.col("_from")  # failures before this row; all earlier rows of a run have failed
    out = rows.join(begun, ["url_key", "_run", "_seg"])
    return out.select(*log.columns, "url_key", ((count >= threshold) & (F.col("_n") > F.col("_from"))).alias("skip_direct"),
                      F.when(F.col("_f"), count + 1).otherwise(0).cast("int").alias("failures"))


#: Time buckets of a group of buckets.
BUCKETS = 512


def _composed(steps: DataFrame, group: list[str], order: str, states: int) -> tuple[DataFrame, DataFrame]:
    """Compose the functions ``_fn`` (array<int>: the state after, by the state before) of each group in order: every step
    with ``_in``, the state at its begin by the state at its group's begin, and every group with its whole ``_fn``.
    A group's list must be short: a bucket has a segment a cooldown at most, a group of buckets has BUCKETS, and a run
    has a group for each BUCKETS buckets of its time."""
    lists = steps.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, "_fn"))).alias("_l"))
    same = F.sequence(F.lit(0), F.lit(states - 1))
    kind = f"array<struct<o:{dict(steps.dtypes)[order]},i:array<int>>>"
    start = F.struct(same.alias("now"), F.array().cast(kind).alias("out"))

    def step(acc, x):
        return F.struct(F.transform(acc["now"], lambda s: F.get(x["_fn"], s)).alias("now"),
                        F.concat(acc["out"], F.array(F.struct(x[order].alias("o"), acc["now"].alias("i")))).alias("out"))
    folded = lists.select(*group, F.aggregate("_l", start, step).alias("_r"))
    each = folded.select(*group, F.explode("_r.out").alias("_o")).select(*group, F.col("_o.o").alias(order), F.col("_o.i").alias("_in"))
    return each, folded.select(*group, F.col("_r.now").alias("_fn"))
