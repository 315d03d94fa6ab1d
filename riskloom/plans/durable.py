"""Results that must outlive an executor are written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`.

    Only a local session may fall back to a fresh temporary folder: on a
    cluster a machine-local path would be lost with its machine.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="riskloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def use_shared_checkpoints(spark: SparkSession) -> None:
    """Let MLlib cut the lineage of its rounds in the shared folder."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below a folder of this application, which may go once the application has ended."""
    return f"{shared_dir(spark)}/riskloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write once, read many: cuts lineage and keeps column pruning (parquet).

    `group_rows` is for rows of a megabyte each: the writer buffers a row group and
    the reader takes one whole; its size in bytes counts compressed ones, so it is
    bounded by rows.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows).option("parquet.page.size.row.check.min", 1)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a frame over all cores before iterative fits; nothing runs until it is read."""
    spark = df.sparkSession
    want = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(want, *keys) if keys else df.repartition(want)


def in_even_parts(df: DataFrame) -> DataFrame:
    """Parts of about `spark.sql.adaptive.advisoryPartitionSizeInBytes`, whatever the size of the frame.

    MLlib keeps each part of its input as one block of objects, many times as
    large as the stored columns; files are read 128 MB at a time, columns that a
    fit leaves out included.
    """
    return df.hint("rebalance")
