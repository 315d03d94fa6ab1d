"""Tables and records in, tables out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.numbers import INTEGER_TEXT, NULL_TOKENS, NUMBER_TEXT, is_floating, nan_free, nan_to_null, quoted
from .ranges import read_split_csv


class TableNotFound(FileNotFoundError):
    """The path does not exist; reported apart from every other read error."""


def paths_like(spark: SparkSession, pattern: str) -> list[str]:
    """The existing paths that a pattern names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().toString() for f in fs.globStatus(hadoop) or []]


def require_path(spark: SparkSession, path: str) -> None:
    if not paths_like(spark, path):
        raise TableNotFound(f"no such table: {path}")


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    def one(f: T.StructField):
        c = quoted(f.name)
        present = F.when(~c.isin(*NULL_TOKENS), c)
        if isinstance(f.dataType, T.StringType):
            return present.alias(f.name)
        value = present.try_cast(f.dataType)
        return (nan_to_null(value, f.dataType.simpleString()) if is_floating(f.dataType) else value).alias(f.name)

    return df.select(*[one(f) for f in schema.fields])


BOOLEAN_TEXT = r"^(True|TRUE|true|False|FALSE|false)$"


def infer_types(text: DataFrame) -> T.StructType:
    """long, double, boolean or string per text column, decided in one pass.

    A column of integers with gaps is double, and so is a column without any
    value.
    """
    aggs = []
    for i, c in enumerate(text.columns):
        x = F.when(~quoted(c).isin(*NULL_TOKENS), quoted(c))
        aggs += [
            F.count_if(x.isNull()).alias(f"null{i}"),
            F.count_if(x.isNotNull() & ~x.rlike(NUMBER_TEXT)).alias(f"text{i}"),
            F.count_if(x.isNotNull() & ~x.rlike(BOOLEAN_TEXT)).alias(f"word{i}"),
            F.count_if(x.isNotNull() & ~(x.rlike(INTEGER_TEXT) & x.try_cast("long").isNotNull())).alias(f"real{i}"),
        ]
    row = text.agg(*aggs).first()
    fields = []
    for i, c in enumerate(text.columns):
        if row[f"text{i}"] > 0:
            kind = T.StringType() if row[f"word{i}"] > 0 else T.BooleanType()
        elif row[f"real{i}"] > 0 or row[f"null{i}"] > 0:
            kind = T.DoubleType()
        else:
            kind = T.LongType()
        fields.append(T.StructField(c, kind))
    return T.StructType(fields)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, format: str | None = None,
               multi_line: bool | str = False) -> DataFrame:
    """Header CSV or parquet to a typed table with NaN as null.

    CSV columns are read as text, the usual spellings of "missing" become
    null, and the rest is cast. With a schema this is one lazy pass; without
    one, types are found in a pass of their own. Line breaks inside quotes need
    `multi_line`: "split" reads each file in ranges (`ranges.split_records`) and
    needs balanced quotes, True makes each file one task and, where lines end
    with \\r\\n, turns the breaks inside values into \\n.
    """
    require_path(spark, path)
    kind = format or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if kind == "parquet":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return nan_free(reader.parquet(path))
    if kind != "csv":
        raise ValueError(f"unknown format {kind!r}")
    if multi_line == "split":
        text = read_split_csv(spark, path)
    else:
        text = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)
    if schema is None:
        schema = infer_types(text)
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return _typed(text, schema)


def write_table(df: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists") -> None:
    """Header CSV or parquet, one file per partition."""
    writer = df.write.mode(mode)
    if format == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {format!r}")


def records_from(df: DataFrame, fields: list[str], column: str = "value") -> DataFrame:
    """JSON text in `column` to one text column per field.

    Adds `present` (the names the record holds, also with a null value) and
    `has_data` (false for empty or malformed records). Other columns stay.
    """
    rest = [quoted(c) for c in df.columns if c != column]
    parsed = df.select(*rest, F.from_json(F.col(column), "map<string,string>").alias("_m"))
    return parsed.select(
        *rest,
        *[F.try_element_at("_m", F.lit(f)).alias(f) for f in fields],
        F.coalesce(F.map_keys("_m"), F.array().cast("array<string>")).alias("present"),
        F.coalesce(F.cardinality("_m") > 0, F.lit(False)).alias("has_data"),
    )


def frame_of_records(spark: SparkSession, records: list[dict]) -> DataFrame:
    """A few records at hand, as the JSON frame that `read_records` takes."""
    return spark.createDataFrame([(json.dumps(r),) for r in records], "value string")


def read_records(source: SparkSession, path_or_df: str | DataFrame, fields: list[str]) -> DataFrame:
    """JSON lines (a path, or a frame with a `value` text column) to raw text records."""
    if isinstance(path_or_df, DataFrame):
        return records_from(path_or_df, fields)
    require_path(source, path_or_df)
    return records_from(source.read.text(path_or_df), fields)


__all__ = [
    "TableNotFound", "frame_of_records", "infer_types", "paths_like", "read_records", "read_table", "records_from",
    "require_path", "write_table",
]
