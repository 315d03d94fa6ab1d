"""Codes and column names to display texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numbers import number_or_null
from ..plans.small import local_frame, pin_small

CODEBOOK_SCHEMA = "feature string, code double, text string"


def codebook(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return local_frame(spark, [(f, float(c), t) for f, c, t in rows], CODEBOOK_SCHEMA)


def name_book(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return local_frame(spark, rows, "feature string, name string")


def decode_values(df: DataFrame, book: DataFrame, feature: str = "feature", value: str = "value", out: str = "value_text") -> DataFrame:
    """Add the text of (feature, code); the code is matched as a number, unknown codes stay as they are.

    The book is broadcast if it is proven small.
    """
    b = pin_small(book.select(F.col("feature").alias("_f"), F.col("code").alias("_code"), F.col("text").alias("_text")))
    code = number_or_null(F.col(value).cast("string"))
    joined = df.join(b, (F.col(feature) == F.col("_f")) & (code == F.col("_code")), "left")
    return joined.select(*df.columns, F.coalesce("_text", F.col(value).cast("string")).alias(out))


def decode_names(df: DataFrame, book: DataFrame, feature: str = "feature", out: str = "feature_name") -> DataFrame:
    """Add the display name of a column; unknown names stay as they are."""
    b = pin_small(book.select(F.col("feature").alias("_f"), F.col("name").alias("_name")))
    joined = df.join(b, F.col(feature) == F.col("_f"), "left")
    return joined.select(*df.columns, F.coalesce("_name", F.col(feature)).alias(out))
