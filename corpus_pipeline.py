"""A training-data pipeline over `documents`: language id, SimHash near-duplicates, personal data, source mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import bpe, language, mixing, pii, simhash
from webloom.llm.common import columns_without, table, written
from webloom.llm.queries import TOKENIZER

#: Columns of documents that every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told: those predicted ``und`` (null, or without a letter) go, all others
    stay. The prediction fills ``lang`` where it is null. The model is fitted on this stage's own input. Repeated rows stay,
    an empty table gives none, columns that documents don't have go."""
    model = language.train(language.training_rows(docs, "text", "lang"), spark)
    names = list(docs.columns)
    told = language.identify(docs.select(*[f"`{c}`" for c in columns_without(docs, ("lang_pred", "score"))]), model, "text")
    return told.where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*_known(names))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash class, the one of smallest doc_id (a null one only if the class has no other;
    of rows with one doc_id and different contents, the one of smallest content hash; of equal rows, one)."""
    names = _known(docs.columns)
    row = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    rows = docs.select(*names, row.alias("__row"))
    found = written(simhash.near_duplicates(rows, ["doc_id", "__row"], "text", shingle=4, max_bits=4), "classes")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__row")).alias("best"))
    kept = best.select(F.col("best.doc_id").alias("__id"), F.col("best.__row").alias("__kept"))
    one = rows.join(kept, (F.col("__row") == F.col("__kept")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return one.dropDuplicates(["__row"]).select(*names)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in ``text`` by ``<kind>`` and counts ``n_chars`` again; no document goes. A null text
    stays null, with a null count; repeated rows stay, an empty table gives none, columns that documents don't have go."""
    return pii.redact(docs.select(*_known(docs.columns)), "text").withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document by its source's target rate: shares by the square root of source size, as many rows as
    came in. Copies are rows of their own. Every row has a draw and a place of its own, by doc_id, a hash of its contents
    and, among equal rows, a number: these are counted as one row and dealt out again, so no task holds all of them."""
    names = _known(docs.columns)
    counted = docs.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).withColumn("__row", F.xxhash64(*names))
    rows = counted.withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(*names, "__row", "__nth")
    return mixing.mix(rows, mixing.source_rates(docs, "source"), "source", ("doc_id", "__row", "__nth"), seed=42).select(*names)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, the ``decoded`` vocabulary strings of these ids, and ``round_trip``: whether they
    spell the words of the text. Null and empty texts have no ids; every row stays."""
    return bpe.coded(docs, TOKENIZER, "text", keep=["doc_id", "lang", "source"])


def _known(names: list[str]) -> list[str]:
    return [c for c in COLUMNS if c in names]


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("personal_data", personal_data),
          ("source_mix", source_mix), ("tokens", tokens)]

#: Linear models, fingerprints and tokens have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
