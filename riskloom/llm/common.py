"""Small helpers of the operators."""

from __future__ import annotations

import ctypes
import os
import shutil
import sys
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.numbers import quoted

ROW = "_llm_row"


def fields(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def arrow_of(ddl: str) -> pa.Schema:
    return to_arrow_schema(fields(ddl))


_SHIPPED: set[str] = set()
_LIBC = ctypes.CDLL(None) if sys.platform == "linux" else None
if not hasattr(_LIBC, "malloc_trim"):
    _LIBC = None


#: Whole texts go to Python in batches of about so many bytes, where the session has not set its own bound.
BATCH_BYTES = 8_000_000
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application; batches of long texts are cut by bytes."""
    if spark.conf.get(_BOUND, None) == "67108864b":  # Spark's default
        spark.conf.set(_BOUND, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        into = os.path.join(tempfile.mkdtemp(prefix="riskloom-"), "riskloom-package")  # served by the driver
        spark.sparkContext.addPyFile(shutil.make_archive(into, "zip", os.path.dirname(package), os.path.basename(package)))
        _SHIPPED.add(app)


def give_back() -> None:
    """Return the memory that a Python worker has freed to the machine: workers live through many stages and would keep it."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, text) under fixed names, for Python tasks; null texts stay null."""
    ship(docs.sparkSession)
    return docs.select(
        quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"),
        *[quoted(c).alias(c) for c in more],
    )


def fold(id_col, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def renamed(df: DataFrame, id_col: str) -> DataFrame:
    return df.withColumnRenamed("doc_id", id_col)
