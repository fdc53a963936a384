"""Connected components of a link table, as Spark jobs over tables in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node reachable, for every node of a link between two different nodes.

    Alternates large-star and small-star steps: each node hands its neighbours to the smallest node it knows, until
    the links are stars and nothing changes. The number of rounds grows with the logarithm of the longest path, and
    links never become more. Both steps take minima by partial aggregates and join on a node; a hub's rows are an
    inner join's side, which adaptive execution splits. Each round is a table that the next one reads."""
    now = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    seen = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = _state(now)
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(links: DataFrame):
    """Number of links and two order-free sums of their hashes: equal only if the links are equal."""
    h = F.xxhash64("u", "v")
    return links.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 20)), F.sum(h.bitwiseAND(F.lit((1 << 40) - 1)))).first()
