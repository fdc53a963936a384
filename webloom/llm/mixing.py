"""Mixing sources to target weights by Poisson replication.

Each document is repeated a Poisson number of times whose mean is its source's target repetition rate. The number
is found by inverting the distribution at a uniform value taken from a hash of the seed and the document, so any
task recomputes the same count without state; copies are exploded and shuffled globally by a second hash."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.common import let
from webloom.llm.common import written

#: A mean above this is split into equal parts, each drawn with its own hash (a sum of Poissons is Poisson), so that
#: exp(-mean) keeps its precision at any rate.
MAX_MEAN = 16.0
#: Terms of the inverted distribution; beyond them P(X > k) at MAX_MEAN is below the 2**-52 step of the uniform value.
TERMS = 80
#: Rows of rates up to which they are broadcast; beyond, the join is a plain one that adaptive execution splits.
BROADCAST_RATES = 100_000


def hashed_uniform(*parts: Column) -> Column:
    """In [0, 1): the first 52 bits of an MD5 of the parts joined by ``:``."""
    return F.conv(F.substr(F.md5(F.concat_ws(":", *parts)), F.lit(1), F.lit(13)), 16, 10).cast("double") / float(2 ** 52)


def poisson_inverse(u: Column, mean: Column) -> Column:
    """Smallest k with u < P(X <= k), as the number of k whose distribution function is at most u."""
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("cdf"), F.lit(0).alias("n"))

    def step(acc, k):
        term = acc["term"] * mean / k
        return F.struct(term.alias("term"), (acc["cdf"] + term).alias("cdf"),
                        (acc["n"] + F.when(acc["cdf"] <= u, 1).otherwise(0)).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["n"])


def replication_count(rate: Column, key: list[Column], seed: int) -> Column:
    parts = F.greatest(F.ceil(rate / MAX_MEAN).cast("int"), F.lit(1))

    def draw(i):
        return let(hashed_uniform(F.lit(str(seed)), i.cast("string"), *key), lambda u: poisson_inverse(u, rate / parts))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, i: n + draw(i))).otherwise(0)


def source_rates(docs: DataFrame, source: str, weights: dict[str, float] | None = None, total: float | None = None,
                 exponent: float = 0.5) -> DataFrame:
    """Target repetition rate of each source: ``weight * total / documents of the source``.

    ``weights`` are target shares by source (normalised; sources not named get 0). Without them a source's weight is
    its number of documents to the power ``exponent``. ``total`` is the wanted number of rows (default: as many as
    there are). The null source is a source of its own, weighted like any other, or 0 with explicit weights.
    All counts cover the whole input; one partial row per source and task is shuffled."""
    n = docs.groupBy(F.col(f"`{source}`").alias("source_key")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        w = F.pow(F.col("n_docs").cast("double"), F.lit(float(exponent)))
    else:
        if any(v < 0 or math.isnan(v) for v in weights.values()) or not sum(weights.values()) > 0:
            raise ValueError("weights must be >= 0 and not all 0")
        w = F.lit(0.0)
        for k, v in weights.items():
            w = F.when(F.col("source_key") == k, F.lit(float(v))).otherwise(w)
    n = n.withColumn("w", w)
    sums = n.agg(F.sum(F.when(F.col("w") > 0, F.col("w"))).alias("w_all"), F.sum("n_docs").alias("n_all"))
    budget = F.col("n_all").cast("double") if total is None else F.lit(float(total))
    return n.crossJoin(sums).select("source_key", "n_docs", (F.col("w") / F.col("w_all")).alias("weight"),
                                    (F.col("w") * budget / (F.col("w_all") * F.col("n_docs"))).alias("rate"))


def mix(docs: DataFrame, rates: DataFrame, source: str = "source", key: tuple[str, ...] = ("doc_id",),
        seed: int = 42, n_out: int | None = None) -> DataFrame:
    """Every document repeated by its Poisson count, in a global pseudo-random order: all columns of ``docs``, then
    ``copy`` (from 1), ``copies`` and ``mix_key`` (input columns of these names are dropped). Rows are dealt to
    partitions by ``mix_key`` and sorted by it inside, which is a global shuffle as far as keys differ.

    Rates are joined on the source. The draw and ``mix_key`` depend on seed and ``key`` alone, so rows with one key get
    one count, each, and their copies of one number share a partition; null keys are the empty string. Where a key may
    be null or repeated, name columns in ``key`` that tell rows apart, as the pipeline does. A source without a rate gets 0. Empty input gives an empty result."""
    added = ("copy", "copies", "mix_key", "source_key", "rate")
    kept = [c for c in docs.columns if c.lower() not in added]
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in key]
    r = written(rates.select("source_key", "rate"), "rates")
    if r.count() <= BROADCAST_RATES:
        r = F.broadcast(r)
    rated = docs.select(*[f"`{c}`" for c in kept]).join(r, F.col(f"`{source}`").eqNullSafe(F.col("source_key")), "left")
    counted = rated.withColumn("copies", replication_count(F.coalesce("rate", F.lit(0.0)), parts, seed)).where("copies > 0")
    copies = (counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
              .withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), F.col("copy").cast("string"), *parts))))
    out = copies.select(*[f"`{c}`" for c in kept], "copy", "copies", "mix_key")
    dealt = out.repartition(n_out, "mix_key") if n_out else out.repartition("mix_key")
    return dealt.sortWithinPartitions("mix_key", "copy")
