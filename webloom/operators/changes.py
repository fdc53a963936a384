"""Change detection (J3, J4, F15, A4, A5) and the snapshot table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.text import content_hash, diff_text, line_diff_counts, line_hashes, url_key
from webloom.session import materialize


def _captures(pages: DataFrame, url: str, content: str, ts: str | None, chars: int | None) -> DataFrame:
    when = F.col(ts) if ts and ts in pages.columns else F.current_timestamp()
    return pages.select(F.col(url).alias("url"), content_hash(F.col(content)).alias("hash"), when.alias("ts"),
                        F.length(content).cast("long").alias("content_length"), line_hashes(F.col(content), chars).alias("lines"))


def snapshot_rows(pages: DataFrame, url: str = "url", content: str = "html", ts: str | None = "ts", chars: int | None = None) -> DataFrame:
    """One snapshot row per capture: sha256, time, length, 64-bit hashes of all lines, md5 url key. ``chars`` keeps the
    line hashes of the first characters only; give the same value to :func:`detect_changes`."""
    return _captures(pages, url, content, ts, chars).withColumn("url_key", url_key(F.col("url")))


def _chained(captures: DataFrame, bucket_s: int) -> DataFrame:
    """``captures`` with ``before``, hash and lines of the capture before it of the same ``url`` and ``late``, by time and hash
    (a null time comes first). A URL's captures are sorted inside time buckets; the first of a bucket takes the last of
    the URL's bucket before, found through bucket numbers alone, of which there is one a URL and bucket. Rows are hashes
    of pages and are written once, as three joins read them; with one bucket a URL nothing is joined to them."""
    when = F.unix_micros(F.col("ts").cast("timestamp"))
    dealt = captures.withColumn("_b", F.coalesce(F.floor(when / (bucket_s * 1_000_000)).cast("long"), F.lit(-1 << 62)))
    inside = Window.partitionBy("url", "late", "_b").orderBy("ts", "hash")
    rows = materialize(dealt.withColumn("before", F.lag(F.struct("hash", "lines")).over(inside))
                       .withColumn("_last", F.lead(F.lit(True)).over(inside).isNull()), "captures")
    lasts = rows.where("_last")
    follow = lasts.select("url", "late", "_b").withColumn("_p", F.lag("_b").over(Window.partitionBy("url", "late").orderBy("_b"))).where("_p IS NOT NULL")
    ends = lasts.select(F.col("url").alias("_u"), F.col("late").alias("_l"), F.col("_b").alias("_e"), F.struct("hash", "lines").alias("_tail"))
    carry = follow.join(ends, F.col("url").eqNullSafe(F.col("_u")) & (F.col("late") == F.col("_l")) & (F.col("_p") == F.col("_e"))).select(
        F.col("_u"), F.col("_l"), F.col("_b").alias("_e"), "_tail")
    met = rows.join(carry, F.col("url").eqNullSafe(F.col("_u")) & (F.col("late") == F.col("_l")) & (F.col("_b") == F.col("_e")), "left")
    return met.select(*captures.columns, F.coalesce("before", "_tail").alias("before"))


def detect_changes(current: DataFrame, snapshots: DataFrame, url: str = "url", content: str = "html",
                   ts: str | None = "ts", chars: int | None = None, bucket_s: int = 3600) -> DataFrame:
    """Each capture vs the previous capture of its URL in this batch, else the stored snapshot.

    no previous -> (true, 'initial', ''); equal hash -> (false, 'none'); else (true, 'content') with a line diff of the
    whole pages. A capture older than the stored snapshot is (false, 'late'), as on the stream: it is reported, is
    compared with nothing and never becomes a snapshot. ``bucket_s``: captures of one URL are sorted in one task for so many
    seconds of their time at most, so a URL with a large part of all captures is split."""
    snap = snapshots.select("url", F.col("hash").alias("snap_hash"), F.col("lines").alias("snap_lines"), F.col("ts").alias("snap_ts"))
    j = _captures(current, url, content, ts, chars).join(snap, "url", "left")
    j = j.withColumn("late", F.coalesce(F.col("ts") < F.col("snap_ts"), F.lit(False)))
    j = _chained(j, bucket_s)
    prev_hash, prev_lines = F.coalesce("before.hash", "snap_hash"), F.coalesce("before.lines", "snap_lines")
    change = (F.when(F.col("late"), "late").when(prev_hash.isNull(), "initial")
              .when(prev_hash == F.col("hash"), "none").otherwise("content"))
    diff = diff_text(line_diff_counts(F.coalesce(prev_lines, F.array().cast("array<bigint>")), F.col("lines")))
    return j.select(
        "url", change.isin("initial", "content").alias("has_changed"), change.alias("change_type"),
        F.coalesce(F.when(F.col("late"), F.col("snap_hash")).otherwise(prev_hash), F.lit("")).alias("previous_hash"),
        F.col("hash").alias("current_hash"), F.when(change == "content", diff).alias("diff_summary"), "ts", "content_length", "lines")


def next_snapshots(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The latest row per URL after this batch (unchanged URLs keep their stored row); at equal times the larger hash."""
    cols = ["hash", "ts", "content_length", "lines"]
    new = changes.where("change_type <> 'late'").withColumnRenamed("current_hash", "hash").select("url", *cols)
    both = new.unionByName(snapshots.select("url", *cols))
    latest = both.groupBy("url").agg(F.max_by(F.struct(*cols), F.struct("ts", "hash")).alias("s"))
    return latest.select("url", "s.*", url_key(F.col("url")).alias("url_key"))


SNAPSHOT_SCHEMA = "url string, hash string, ts timestamp, content_length long, lines array<bigint>, url_key string"


def _entries(spark, path: str):
    """File system, folder of the version log, and the numbers and names of its committed versions, oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{path.rstrip('/')}/_versions")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(folder) if fs.exists(folder) else ():
        name = status.getPath().getName()
        if name.isdigit() and status.getLen() > 0:  # an empty entry is a commit that died on its way
            stream = fs.open(status.getPath())
            try:
                found.append((int(name), bytes(stream.readNBytes(int(status.getLen()))).decode()))
            finally:
                stream.close()
    return fs, folder, sorted(found)


def write_snapshots(snapshots: DataFrame, path: str, version: str) -> str:
    """Write a version's own folder and then, last, the entry of the version log that makes it the current one.

    Readers go on with the version they read; one that begins before the entry is there sees the one before. A version
    whose write failed is in no entry and may be written again, a committed one is never written again. Log entries
    are created only if absent, so of two writers of one number the second fails."""
    spark, root = snapshots.sparkSession, path.rstrip("/")
    fs, folder, entries = _entries(spark, root)
    if version in [v for _, v in entries]:
        raise ValueError(f"version {version} is there already")
    out = f"{root}/v={version}"
    snapshots.write.mode("overwrite").parquet(out)
    taken = [int(s.getPath().getName()) for s in (fs.listStatus(folder) if fs.exists(folder) else ()) if s.getPath().getName().isdigit()]
    entry = fs.create(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{max(taken, default=0) + 1:010d}"), False)
    entry.write(bytearray(version.encode()))
    entry.close()
    return out


def read_snapshots(spark, path: str, version: str | None = None) -> DataFrame:
    """The current version under ``path``, one row a URL, or the named one while its folder is kept; a table without rows if there
    is none. ``path`` may also be a version's own folder."""
    root = path.rstrip("/")
    _, _, entries = _entries(spark, root)
    if version is None and not entries:
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        if root.rsplit("/", 1)[-1].startswith("v=") and folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.read.parquet(root)
        return spark.createDataFrame([], SNAPSHOT_SCHEMA)
    if version is not None and version not in [v for _, v in entries]:
        raise ValueError(f"no version {version}")
    return spark.read.option("basePath", f"{root}/v={version or entries[-1][1]}").parquet(f"{root}/v={version or entries[-1][1]}")


def monitoring_stats(snapshots: DataFrame) -> DataFrame:
    """A4: per URL last check and a 16-char hash prefix, with the number of monitored URLs on every row."""
    rows = snapshots.select("url", F.col("ts").alias("last_check"), F.concat(F.substring("hash", 1, 16), F.lit("...")).alias("hash"))
    return rows.crossJoin(rows.agg(F.count(F.lit(1)).alias("total_urls")))  # one row on the right side


def monitor_counters(checks: DataFrame) -> DataFrame:
    """A5: per URL: checks, changes (not counting 'initial'), last check."""
    return checks.groupBy("url").agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if((F.col("change_type") == "content")).alias("changes"),
        F.max("ts").alias("last_check"))


def line_diff(old: DataFrame, new: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """J4 for whole documents: occurrences of lines absent on the other side. Lines of both sides are counted by
    (key, line), then by key: two partial aggregates, linear in the text size. A null text has no lines."""
    def lines(df, side):
        return df.select(key, F.explode_outer(F.split(text, "\n", -1)).alias("line"), F.lit(side).alias("side"))
    def count(side):
        return F.count_if((F.col("side") == side) & F.col("line").isNotNull())
    counted = (lines(old, 0).unionByName(lines(new, 1)).groupBy(key, "line").agg(count(0).alias("before"), count(1).alias("after")))
    return counted.groupBy(key).agg(F.sum(F.when(F.col("before") == 0, F.col("after")).otherwise(0)).alias("added"),
                                    F.sum(F.when(F.col("after") == 0, F.col("before")).otherwise(0)).alias("removed"))
