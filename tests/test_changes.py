import datetime as dt

from pyspark.sql import functions as F

from webloom.operators.changes import detect_changes, monitor_counters, snapshot_rows
from webloom.plans.jobs import check_for_changes


def caps(spark, rows):
    return spark.createDataFrame(rows, "url string, html string, ts timestamp")


def test_initial_none_content(spark):
    t = [dt.datetime(2024, 1, 1, h) for h in range(3)]
    cur = caps(spark, [("u", "v1", t[0]), ("u", "v1", t[1]), ("u", "v2", t[2])])
    empty = snapshot_rows(caps(spark, [("x", "x", t[0])])).where(F.lit(False))
    out = detect_changes(cur, empty).orderBy("ts").collect()
    assert [(r.has_changed, r.change_type) for r in out] == [(True, "initial"), (False, "none"), (True, "content")]
    assert out[0].previous_hash == "" and len(out[0].current_hash) == 64
    assert out[2].diff_summary == "+1 lines added, -1 lines removed"
    assert [(r.url, r.checks, r.changes) for r in monitor_counters(detect_changes(cur, empty)).collect()] == [("u", 3, 1)]


def test_hot_url_is_chained_over_time_buckets(spark):
    """A URL with most captures, over many buckets with gaps, equal and null times, late rows, and a null URL."""
    import hashlib
    import random
    rng, t0 = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [("hot", f"v{rng.randrange(3)}", t0 + dt.timedelta(seconds=rng.randrange(40) * 450 + 86_400 * rng.randrange(3))) for _ in range(1500)]
    rows += [("hot", "v1", None), ("hot", "v2", None), ("one", "a", t0), (None, "n1", t0), (None, "n2", t0 + dt.timedelta(days=9)), ("old", "b", t0)]
    rows += [("old", "c", t0 + dt.timedelta(days=2)), ("old", "c", t0 + dt.timedelta(days=3))]
    stored = snapshot_rows(caps(spark, [("old", "b", t0 + dt.timedelta(days=1))]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want, before = [], {"old": sha("b")}
    for u, h, t in sorted(rows, key=lambda r: (str(r[0]), r[2] is not None, r[2] or t0, sha(r[1]))):
        if (u, t) == ("old", t0):
            want.append((str(u), str(t), sha(h), "late", sha("b"), None))
            continue
        was = before.get(u)
        kind = "initial" if was is None else "none" if was == sha(h) else "content"
        want.append((str(u), str(t), sha(h), kind, was or "", "+1 lines added, -1 lines removed" if kind == "content" else None))
        before[u] = sha(h)
    for bucket_s in (900, 3600, 10 ** 9):
        out = detect_changes(caps(spark, rows), stored, bucket_s=bucket_s).collect()
        got = [(str(r.url), str(r.ts), r.current_hash, r.change_type, r.previous_hash, r.diff_summary) for r in out]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_snapshot_roundtrip_and_monitoring(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    stored = snapshot_rows(caps(spark, [("a", "1", t0), ("b", "2", t0)]))
    changes, snaps = check_for_changes(caps(spark, [("a", "1", t1), ("b", "3", t1), ("c", "4", t1)]), stored)
    got = {r.url: r.change_type for r in changes.collect()}
    assert got == {"a": "none", "b": "content", "c": "initial"}
    assert snaps.count() == 3 and {r.ts for r in snaps.collect()} == {t1}


def test_stream_equals_batch(spark, tmp_path):
    from webloom.streaming.monitor import monitor_changes
    t = [dt.datetime(2024, 1, 1, h) for h in range(3)]
    rows = [("u", "v1", t[0]), ("u", "v1", t[1]), ("u", "v2", t[2]), ("w", "z", t[1])]
    src_dir = str(tmp_path / "in")
    caps(spark, rows).coalesce(1).write.parquet(src_dir)
    stream = spark.readStream.schema("url string, html string, ts timestamp").parquet(src_dir)
    q = (monitor_changes(stream, emit_unchanged=True).writeStream.format("parquet")
         .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    s = sorted((r.url, r.change_type, r.current_hash) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    empty = snapshot_rows(caps(spark, rows)).where(F.lit(False))
    b = sorted((r.url, r.change_type, r.current_hash) for r in detect_changes(caps(spark, rows), empty).collect())
    assert s == b


def test_equal_texts_of_any_length_have_no_diff(spark):
    from webloom.functions.text import diff_summary
    long = "\n".join(f"line {i}" for i in range(500))
    df = spark.createDataFrame([(long, long, long.replace("line 450", "edited"))], "a string, b string, c string")
    r = df.select(diff_summary("a", "b").alias("same"), diff_summary("a", "c").alias("one"), diff_summary("a", "c", chars=100).alias("cut")).first()
    assert tuple(r) == ("+0 lines added, -0 lines removed", "+1 lines added, -1 lines removed", "+0 lines added, -0 lines removed")


def test_line_diff_counts_occurrences(spark):
    from webloom.operators.changes import line_diff
    old = spark.createDataFrame([(1, "a\nb\nb"), (2, None), (3, "x")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "a\nc\nc\nc"), (2, "y"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.added, r.removed) for r in line_diff(old, new).collect()}
    assert got == {1: (3, 2), 2: (1, 0), 3: (0, 1), 4: (0, 0)}


def test_late_captures_are_one_rule(spark, tmp_path):
    from webloom.streaming.monitor import monitor_changes
    t0, t1, t2 = (dt.datetime(2024, 1, d) for d in (1, 2, 3))
    stored = snapshot_rows(caps(spark, [("u", "two", t1)]))
    late = caps(spark, [("u", "one", t0), ("u", "three\nlines", t2)])
    changes, snaps = check_for_changes(late, stored)
    assert [(r.change_type, r.has_changed) for r in changes.orderBy("ts").collect()] == [("late", False), ("content", True)]
    assert [r.ts for r in snaps.collect()] == [t2]
    assert check_for_changes(late.where("ts < '2024-01-02'"), stored)[1].first().ts == t1  # a late capture is no snapshot
    for part, rows in (("a", caps(spark, [("u", "two", t1)])), ("b", late)):
        rows.write.parquet(str(tmp_path / "in" / part))
        src = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        (monitor_changes(src, emit_unchanged=True).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination())
    got = sorted((r.ts, r.change_type, r.diff_summary) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(t0, "late", None), (t1, "initial", None), (t2, "content", "+2 lines added, -1 lines removed")]


def test_snapshot_versions_are_written_and_read(spark, tmp_path):
    from webloom.operators.changes import monitoring_stats, read_snapshots, write_snapshots
    snaps = snapshot_rows(caps(spark, [("a", "1", dt.datetime(2024, 1, 1)), ("b", "2", dt.datetime(2024, 1, 1))]))
    path = write_snapshots(snaps, str(tmp_path / "snap"), "7")
    back = read_snapshots(spark, path)
    assert path.endswith("/v=7") and sorted(map(str, back.select(*snaps.columns).collect())) == sorted(map(str, snaps.collect()))
    assert {(r.url, r.total_urls, len(r.hash)) for r in monitoring_stats(back).collect()} == {("a", 2, 19), ("b", 2, 19)}


def test_the_version_log_names_the_current_snapshot(spark, tmp_path):
    import pytest
    from webloom.operators.changes import SNAPSHOT_SCHEMA, read_snapshots, write_snapshots
    root = str(tmp_path / "snap")
    none = read_snapshots(spark, root)
    assert none.count() == 0 and none.schema == spark.createDataFrame([], SNAPSHOT_SCHEMA).schema
    first = caps(spark, [("a", "1", dt.datetime(2024, 1, 1)), ("b", "2", dt.datetime(2024, 1, 1))])
    changes, snaps = check_for_changes(first, none)
    assert {r.change_type for r in changes.collect()} == {"initial"}
    write_snapshots(snaps, root, "one")
    held = read_snapshots(spark, root)
    changes, snaps = check_for_changes(caps(spark, [("a", "x", dt.datetime(2024, 1, 2))]), held)
    assert [r.change_type for r in changes.collect()] == ["content"]
    write_snapshots(snaps, root, "two")
    assert sorted((r.url, r.ts.day) for r in read_snapshots(spark, root).collect()) == [("a", 2), ("b", 1)]
    assert sorted((r.url, r.ts.day) for r in held.collect()) == [("a", 1), ("b", 1)]  # a reader keeps its version
    assert read_snapshots(spark, root, "one").count() == 2
    # a write that died before its entry, or with an empty one, isn't seen and may be done again
    snaps.limit(1).write.parquet(root + "/v=three")
    (tmp_path / "snap" / "_versions" / "0000000003").write_text("")
    assert read_snapshots(spark, root).count() == 2
    write_snapshots(snaps.limit(1), root, "three")
    assert read_snapshots(spark, root).count() == 1
    for call in (lambda: write_snapshots(snaps, root, "one"), lambda: read_snapshots(spark, root, "four")):
        with pytest.raises(ValueError):
            call()


def test_watch_list_events_and_replay(spark, tmp_path):
    import json
    from webloom.streaming.monitor import monitor_changes, subscribe, watched
    schema = "url string, html string, ts timestamp, status_code int"
    rows = [("a", "x", dt.datetime(2024, 1, 1), 200), ("b", "x", dt.datetime(2024, 1, 1), 200), ("a", "", dt.datetime(2024, 1, 2), 500)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    wanted = spark.createDataFrame([("a",), ("a",), ("z",)], "url string")
    events = monitor_changes(watched(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), wanted))
    subscribe(events, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    payloads = [json.loads(r.payload) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert [(p["url"], p["change_type"], p["timestamp"]) for p in payloads] == [("a", "initial", "2024-01-01T00:00:00.000000")]
    got = []
    again = monitor_changes(watched(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), wanted))
    subscribe(again, "", str(tmp_path / "ck2"), fn=lambda batch, i: got.append((i, batch.count()))).awaitTermination()
    assert got[0] == (0, 1)


def test_state_expires_on_event_time(spark, tmp_path):
    """T7 under availableNow, each run restarted from the checkpoint: the timer drops u's state once v moves the watermark."""
    from webloom.streaming.monitor import monitor_changes
    schema = "url string, html string, ts timestamp"
    (tmp_path / "in").mkdir()
    src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    day = lambda n: dt.datetime(2024, 1, n)
    for part, rows in (("a", [("u", "same", day(1)), ("w", "same", day(1))]), ("b", [("w", "same", day(2))]), ("c", [("v", "x", day(5))]),
                       ("d", [("u", "same", day(6)), ("w", "other", day(6)), ("v", "x", day(6))])):
        caps(spark, rows).write.parquet(str(tmp_path / "in" / part))
        (monitor_changes(src, emit_unchanged=True, ttl_ms=2 * 86_400_000).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination())
    got = sorted((r.url, r.ts.day, r.change_type) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("u", 1, "initial"), ("u", 6, "initial"), ("v", 5, "initial"), ("v", 6, "none"),
                   ("w", 1, "initial"), ("w", 2, "none"), ("w", 6, "initial")]


def test_captures_without_a_time_are_late(spark, tmp_path):
    from webloom.streaming.monitor import monitor_changes
    schema = "url string, html string, ts timestamp"
    rows = [("u", "one", None), ("u", "one", dt.datetime(2024, 1, 1)), ("u", None, dt.datetime(2024, 1, 2)), ("u", "two\nlines", dt.datetime(2024, 1, 3))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    events = monitor_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), emit_unchanged=True)
    (events.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
     .trigger(availableNow=True).start().awaitTermination())
    got = [(r.ts and r.ts.day, r.change_type) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=str)[-1] == (None, "late") and len(got) == 4


def test_diff_of_200_000_changed_lines(spark):
    from webloom.functions.text import diff_summary
    df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.concat(F.lit("old "), i)), "\n").alias("a"),
                               F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200_001)), lambda i: F.concat(F.lit("new "), i % 70_000)), "\n").alias("b"))
    assert df.select(diff_summary("a", "b").alias("d")).first().d == "+200001 lines added, -200000 lines removed"
