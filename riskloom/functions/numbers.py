"""Number parsing and null handling as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Texts that a header CSV reader takes for "missing".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Plain decimal, exponent, infinity or nan. Rejects Spark-only suffixes such as 1d.
_DECIMAL = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
_SPECIAL = r"[+-]?(?i:inf|infinity|nan)"
NUMBER_TEXT = rf"^\s*({_DECIMAL}|{_SPECIAL})\s*$"
FINITE_OR_INF_TEXT = rf"^\s*({_DECIMAL}|[+-]?(?i:inf|infinity))\s*$"
# As NUMBER_TEXT, with single underscores allowed between digits (1_000).
_GROUPED = r"[+-]?(\d(_?\d)*\.?(\d(_?\d)*)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?"
GROUPED_NUMBER_TEXT = rf"^\s*({_GROUPED}|{_SPECIAL})\s*$"
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str, kind: str = "double") -> Column:
    """NaN becomes null; `c` is evaluated once."""
    return F.nanvl(_col(c), F.lit(None).cast(kind))


def as_double(c: Column | str) -> Column:
    """Double with NaN turned into null."""
    return nan_to_null(_col(c).cast("double"))


def double_of(df: DataFrame, name: str) -> Column:
    """`as_double` of a column of `df`, without the NaN test where its type has no NaN."""
    c = _q(name).cast("double")
    return c if isinstance(df.schema[name].dataType, _INTEGERS) else nan_to_null(c)


def number_or_null(c: Column | str) -> Column:
    """Text to double; unparsable text and the text nan become null."""
    c = _col(c)
    return F.when(c.rlike(FINITE_OR_INF_TEXT), c.try_cast("double"))


def grouped_number_or_null(c: Column | str) -> Column:
    """Text to double, digit groups such as 1_000 allowed; NaN and infinities stay."""
    c = _col(c)
    return F.when(c.rlike(GROUPED_NUMBER_TEXT), F.replace(c, F.lit("_"), F.lit("")).try_cast("double"))


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where the ratio is undefined."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def nan_free(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column, in one projection."""
    floats = {f.name: f.dataType.simpleString() for f in df.schema.fields if is_floating(f.dataType)}
    if not floats:
        return df
    return df.select(*[nan_to_null(_q(c), floats[c]).alias(c) if c in floats else _q(c) for c in df.columns])


def _q(name: str) -> Column:
    """Column by exact name, also when the name holds a dot."""
    return F.col("`" + name.replace("`", "``") + "`")


quoted = _q
