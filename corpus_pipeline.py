"""The corpus pipeline: the stages in order, each on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm import exact, language, minhash, packing, pii
from riskloom.llm.common import table
from riskloom.plans.durable import materialise


#: Executors run all stages one after the other, so texts go to their workers in batches of about so many bytes.
BATCH_BYTES = 1_000_000
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most `BATCH_BYTES` for what runs inside; the session's own bound comes back."""
    own = spark.conf.get(_BOUND)
    spark.conf.set(_BOUND, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BOUND, own)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without any language go; the profiles are learned from all documents that name theirs."""
    with small_batches(spark):
        profiles = language.fit_profiles(docs, F.lit(True))
        return language.keep_identified(docs, profiles)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact.drop_exact_copies(docs)


#: Shingle sets as similar as this are near copies in the corpus; op1's own contract is 85/100.
NEAR = (80, 100)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    with small_batches(spark):
        return minhash.drop_near_copies(docs, threshold=NEAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    # workers come here with what the stages before have left, hence the smaller bounds, and leave nothing for the next stage
    with small_batches(spark):
        return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, kept_units=50_000, chars=250_000, hold=False)


STAGES = [
    ("language id", language_id),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("personal data", personal_data),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
