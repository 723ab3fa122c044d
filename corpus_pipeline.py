"""The corpus pipeline: STAGES applied to documents, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result
as Parquet in the shared folder and reads it again as the next stage's docs.  All stages
but the last return the columns of documents; other columns of their input are left out,
whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, ngram_join, packing, pii, quality
from millrace.llm.common import per_batch, settle
from millrace.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORD_BPE = "word_bpe_49k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the weakly trained scorer keeps, each on its own: null and repeated ids change nothing.  Null, empty and blank texts go."""
    ship(spark)
    return quality.kept_documents(docs, COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word shingle Jaccard 0.8 or more: that of the smallest id.

    Rows that share an id are one document; the least of them stays.  Rows without an id
    cannot be told apart and all stay, as do null and empty texts.
    """
    ship(spark)
    found = ngram_join.jaccard_components(docs, n=5, threshold=Fraction(8, 10)).select("doc_id", "component_id")
    found = settle(found.where("doc_id is not null"), "components")
    out = _without(docs, settle(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies"), "doc_id")
    repeated = settle(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return out
    least = out.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return _without(out, repeated, "doc_id").union(least.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, each on its own: null and repeated ids change nothing.  Null and empty texts stay."""
    ship(spark)
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    hits = decontaminate.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_column="_key")
    return _without(keyed, settle(hits.select(F.col("doc_id").alias("_key")).distinct(), "hits"), "_key")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind in angle brackets; n_chars follows the text.  Null texts stay null."""
    ship(spark)
    return pii.redacted(docs, COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences of 4096 tokens.  Null and empty texts are the closing id alone."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path(WORD_BPE))


#: Ids to drop up to this many are sent to the documents; more are joined by a shuffle.
SEND_IDS = 1 << 18


def _without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    out = F.broadcast(ids) if ids.count() <= SEND_IDS else ids
    return docs.join(out, key, "left_anti").select(*COLUMNS)


STAGES = [
    ("quality", quality_stage),
    ("ngram_jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: EM, alignment and packing cannot be put in SQL; the tests hold each stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
