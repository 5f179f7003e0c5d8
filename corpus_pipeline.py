"""From documents to tokens: quality, near-duplicates, secrets, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of ``documents``. The rows
of a stage are to be written before the next stage begins: that deletes the
tables which earlier stages made for themselves, but for those that its own
``docs`` read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, mixing, neardup, quality, secrets
from millrace.storage import collected, discard, materialize, read_by

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the stages made so far and that are still there.
_left: list[str] = []


def _tidy(stage: Stage) -> Stage:
    """The stage, after deleting what earlier ones left."""

    @wraps(stage)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _left[:] = discard(spark, _left, keep=docs)
        with collected(_left):
            return stage(spark, docs, sf_dir)

    return tidied


@_tidy
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    return quality.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_tidy
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return neardup.drop_near_copies(docs)


@_tidy
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


@_tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


@_tidy
def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.digest_documents(docs, bpe.vocabulary())


STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_each),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", to_tokens),
]

#: The stages learn, hash and tokenise; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next; only the last one's rows stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made: list[str] = []
    for name, stage in STAGES:
        with collected(made):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spark, made, keep=docs)
        made = sorted(read_by(docs))
    return docs
