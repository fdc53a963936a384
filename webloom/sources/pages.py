"""Page archive scan (S1) and batch URL lookup (S2): a "fetch" is a join with pages someone landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``(url, status_code, html, headers?, success, error)``; success = status 200 and html
    blank unless successful.  Missing status means 200 when html is present."""
    df = spark.read.format(fmt).load(path)
    if "status_code" not in df.columns:
        df = df.withColumn("status_code", F.when(F.col("html").isNotNull(), F.lit(200)).cast("int"))
    ok = F.coalesce(F.col("status_code") == 200, F.lit(False))
    df = df.withColumn("success", ok).withColumn("html", F.when(ok, F.col("html")).otherwise(F.lit("")))
    if "error" not in df.columns:
        df = df.withColumn("error", F.when(~ok, F.concat(F.lit("HTTP "), F.coalesce(F.col("status_code").cast("string"), F.lit("?")))))
    return df


def latest_pages(pages: DataFrame, ts: str | None = None) -> DataFrame:
    """One row per URL: the latest by ``ts`` (a column named ts if there is one), then a successful one, then the
    largest row, so that the choice is the same in every run.

    The greatest (ts, success) of a URL comes from a scan of these columns alone; rows that have it are found by a join on
    the URL, so markup is shuffled once and only a URL's equally late rows meet in the aggregate, which keeps that partitioning.
    Rows without a URL are one group of their own."""
    return _latest_named(pages.where("url is not null"), ts).unionByName(_largest(pages.where("url is null"), _ahead(pages, ts)))


def _ahead(pages: DataFrame, ts: str | None) -> list[str]:
    return [c for c in dict.fromkeys([ts or "ts", "success"]) if c in pages.columns and c != "url"]


def _largest(rows: DataFrame, ahead: list[str]) -> DataFrame:
    cols = [c for c in rows.columns if c != "url"]
    plain = [c for c in cols if rows.schema[c].dataType.typeName() not in ("map", "variant")]
    return rows.groupBy("url").agg(F.max_by(F.struct(*cols), F.struct(*ahead, *plain)).alias("_p")).select("url", "_p.*")


def _latest_named(pages: DataFrame, ts: str | None) -> DataFrame:
    ahead = _ahead(pages, ts)
    if not ahead:
        return _largest(pages, ahead)
    best = pages.groupBy("url").agg(F.max(F.struct(*ahead)).alias("__best"))
    late = F.struct(*[F.col(f"`{c}`") for c in ahead]) >= F.col("__best")  # none is above: an order, to join on the URL alone
    return _largest(pages.join(best, "url").where(late).drop("__best"), [])


def fetch_batch(urls: DataFrame, pages: DataFrame, ts: str | None = None) -> DataFrame:
    """Every requested URL gets exactly one outcome row, from the archive's latest row of it, however often either
    side names it; URLs missing from the archive -> success false + error.

    The wanted URLs are distinct, so an inner join keeps the rows that a semi join would. Spark pushes a semi join below a
    union in ``pages``; its legs, joined apart, then claim one partitioning that they lose again at run time (Spark 4.1.2: "Can't zip RDDs")."""
    wanted = urls.select("url").distinct()
    known = _latest_named(pages.join(wanted, "url"), ts)
    cols = [c for c in pages.columns if c != "url"]
    j = wanted.join(known, "url", "left")
    return j.select("url", *[F.col(c) for c in cols if c not in ("success", "error")],
                    F.coalesce(F.col("success"), F.lit(False)).alias("success"),
                    F.when(F.col("success").isNull(), F.lit("not in page archive")).otherwise(F.col("error")).alias("error"))


def successful(pages: DataFrame) -> DataFrame:
    """P4."""
    return pages.where(F.col("success"))
