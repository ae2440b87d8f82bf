"""A corpus pipeline of five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import decontam, nbsvm, neardup, packing, pii
from tidewheel.llm.common import BATCH_BYTES, discard, fold, stash, table


def small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage on a session that sends few MB of rows to Python at once, from then on: its result is made when it is written."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for k, v in BATCH_BYTES.items():
            spark.conf.set(k, v)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return nbsvm.keep_good(docs, nbsvm.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0))


@small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, on five-word shingles."""
    return neardup.keep_first(docs, shingle=5)


@small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.drop_leaky(docs, table(spark, sf_dir, "benchmark"))


@small_batches
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return pii.redact(docs)


@small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]
#: SQL can express none of the learned, hashed and tokenizing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result but the last is written, read again, and removed once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs)
            discard(before)
    return docs
