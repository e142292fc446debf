"""From raw documents to token ids: five stages, each one operator over all that the stage before kept.

In every stage each row is judged by its own text, also where rows share a doc_id or have none.  Null and empty texts are
kept, very long ones are read whole, repeated rows are treated alike (near_duplicates keeps one of them), empty tables
stay empty, and further columns of any name stay as they are (bpe replaces columns with its own names).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, decontam, minhash, secrets, toxicity
from tidewatch.llm.shared import Scratch


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars of texts that may have changed."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else docs


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; texts without words stay."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that with the smallest doc_id; texts without words are no group and all stay."""
    return minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go; n_chars follows the text."""
    return _recount(decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked; widely copied examples stay; every row stays, n_chars follows the text."""
    return _recount(secrets.redact(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the remaining texts; a null or empty text has none."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: Restoration, classification and byte-pair merges can't be written in SQL.  Tests hold what stages call against brute force
#: (groups, cuts, masks, ids, and the lattice decoder against all paths) and toxicity's scores against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
