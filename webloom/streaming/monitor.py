"""Streaming change monitor.

Captures ``(url, html, ts)`` arrive as a stream. The content hash and the 64-bit hashes of all lines are computed
natively *before* the keyed shuffle, so state and shuffle carry hashes, never pages. Per URL the state holds (hash,
line hashes, last ts); each capture is compared with it in time order. Rows older than the state's last ts are late:
they change nothing, and are reported as such when unchanged captures are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from webloom.functions.text import content_hash, line_hashes

EVENT_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("has_changed", T.BooleanType()),
    T.StructField("change_type", T.StringType()), T.StructField("previous_hash", T.StringType()),
    T.StructField("current_hash", T.StringType()), T.StructField("diff_summary", T.StringType()),
    T.StructField("ts", T.TimestampType())])
STATE_SCHEMA = T.StructType([T.StructField("hash", T.StringType()), T.StructField("lines", T.BinaryType()),
                             T.StructField("last_us", T.LongType())])


def _absent(lines, others) -> int:
    """How many of ``lines`` (with repeats) are not among ``others``."""
    return int((~np.isin(np.asarray(lines, np.int64), np.asarray(others, np.int64))).sum())


def watched(stream: DataFrame, watchlist: DataFrame | None = None) -> DataFrame:
    """Only status-200 captures of URLs on the watch list. A plain semi join: Spark broadcasts a list that it
    knows to be under its size threshold, and shuffles any other."""
    if "status_code" in stream.columns:
        stream = stream.where(F.col("status_code") == 200)
    if watchlist is not None:
        stream = stream.join(watchlist.select("url").distinct() if not watchlist.isStreaming else watchlist.select("url"), "url", "left_semi")
    return stream


class ChangeMonitor(StatefulProcessor):
    """T1 with its state in a value state of each URL, and T7 by a timer on event time."""

    def __init__(self, emit_unchanged: bool, ttl_ms: int | None):
        self.emit_unchanged, self.ttl_ms = emit_unchanged, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", STATE_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        url = key[0]
        stored = self.seen.get()  # each call on the state is a round trip to the JVM
        h, before, last = (stored[0], np.frombuffer(stored[1], np.int64), stored[2]) if stored else (None, None, None)
        captures = []
        for pdf in rows:
            captures += zip(pdf["us"].tolist(), pdf["hash"].tolist(), pdf["lines"].tolist(), strict=True)
        captures.sort(key=lambda c: (c[0], c[1] or ""))
        out = []
        for us, new, lines in captures:
            if us < 0 or (last is not None and us < last):  # without a time, or late
                if self.emit_unchanged:
                    out.append((url, False, "late", h, new, None, us))
                continue
            if self.ttl_ms and last is not None and us - last >= self.ttl_ms * 1000:
                h, before = None, None
            lines = [] if lines is None else lines
            if h is None:
                out.append((url, True, "initial", "", new, None, us))
            elif h == new:
                if self.emit_unchanged:
                    out.append((url, False, "none", h, new, None, us))
            else:
                out.append((url, True, "content", h, new, f"+{_absent(lines, before)} lines added, -{_absent(before, lines)} lines removed", us))
            h, before, last = new, lines, us
        if last is not None:
            if stored is None or (h, last) != (stored[0], stored[2]):
                self.seen.update((h, np.asarray(before, np.int64).tobytes(), last))
            if self.ttl_ms:
                expiry = last // 1000 + self.ttl_ms
                for timer in list(self.handle.listTimers()):
                    if timer != expiry:
                        self.handle.deleteTimer(timer)
                self.handle.registerTimer(expiry)
        if out:
            *values, us = zip(*out, strict=True)
            at = np.array([t if t >= 0 else np.iinfo(np.int64).min for t in us]).astype("datetime64[us]")  # the least is NaT
            names = [f.name for f in EVENT_SCHEMA.fields]
            yield pd.DataFrame(dict(zip(names, [*[list(v) for v in values], at], strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def monitor_changes(stream: DataFrame, emit_unchanged: bool = False, ttl_ms: int | None = None, lateness: str = "0 seconds") -> DataFrame:
    """Per-URL keyed state -> change events (initial / content, and none and late when asked).

    ``ttl_ms`` (T7) forgets a URL that long after its last capture, on the captures' own time: the next capture is an initial one, and
    a timer drops the state once the watermark, ``lateness`` behind the newest capture, has passed. This needs no running
    trigger: it holds for ``availableNow`` and over restarts. With it, captures behind the watermark are dropped by
    Spark. A capture without a time is late. Captures of a URL in a micro-batch are taken batch by batch and ordered in
    memory, as hashes."""
    from webloom.session import ship_package
    spark = stream.sparkSession
    ship_package(spark)
    if "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or ""):  # this state needs it
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = F.col("ts").cast("timestamp")
    hashed = stream.select("url", content_hash("html").alias("hash"), line_hashes("html").alias("lines"), at.alias("ts"),
                           F.coalesce(F.unix_micros(at), F.lit(-1)).alias("us"))
    if ttl_ms:
        hashed = hashed.withWatermark("ts", lateness)
    return hashed.groupBy("url").transformWithStateInPandas(
        ChangeMonitor(emit_unchanged, ttl_ms), EVENT_SCHEMA, "append", "EventTime" if ttl_ms else "None")


def event_payload(events: DataFrame) -> DataFrame:
    """S12 payload: one JSON document per change event."""
    return events.select("url", F.to_json(F.struct("url", "has_changed", "change_type",
                                                   F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                                                   "diff_summary")).alias("payload"))


def subscribe(events: DataFrame, path: str, checkpoint: str, fn=None, trigger: dict | None = None):
    """T3 + S12: deliver change events per micro-batch: to a user callback, else as JSON payload rows of a parquet
    outbox with one folder per batch. A batch that is replayed after a failure overwrites its own folder, so no event
    is there twice; a callback gets the batch id to guard itself."""
    def deliver(batch: DataFrame, batch_id: int):
        if fn is not None:
            fn(batch, batch_id)
        else:
            event_payload(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    w = events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()
