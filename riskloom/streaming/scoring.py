"""Scoring of records as they arrive. Stateless: the batch functions run on the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.features import Derived
from ..operators.rules import Rule
from ..operators.score import score_report
from ..sources.bundles import Bundle
from ..sources.tables import records_from


def record_stream(spark: SparkSession, path: str, fields: list[str], max_files: int | None = None) -> DataFrame:
    """Files of JSON lines, picked up as they appear in a folder."""
    reader = spark.readStream.schema(T.StructType([T.StructField("value", T.StringType())])).format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return records_from(reader.load(path), fields)


def score_stream(
    stream: DataFrame,
    bundle: Bundle,
    rules: list[Rule],
    fallback: str,
    texts: dict[int, str],
    specs: list[Derived] = (),
    raw: list[str] | None = None,
    present: str | None = None,
) -> DataFrame:
    """The full answer per arriving record. No state, so no watermark is needed."""
    if not stream.isStreaming:
        raise ValueError("score_stream needs a streaming frame; use score_report for a table")
    return score_report(stream, bundle, rules, fallback, texts, specs, raw, present)


def write_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Append to a parquet folder, exactly once, resuming from `checkpoint`."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start(path)
