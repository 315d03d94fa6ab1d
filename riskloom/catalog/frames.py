"""Frames derived from the given tables, each with the same rule in Spark and in SQL.

The tables hold no gaps, copies or junk, so these rules plant them on whole
tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.draws import digest, slice_to_long, unit
from ..plans.durable import materialise, widen

SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison with another engine."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """The SQL side of `rounded`."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0" + (f" AS {name}" if name else "")


def sql_digest(*parts: str, seed: int = SEED) -> str:
    return "md5(" + " || '|' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]]) + ")"


def sql_hex(h: str, start: int, digits: int) -> str:
    return f"CAST(('0x' || substr({h}, {start}, {digits}))::UBIGINT AS BIGINT)"


def sql_unit(h: str, start: int = 1, digits: int = 13) -> str:
    return f"(CAST({sql_hex(h, start, digits)} AS DOUBLE) / {float(16**digits)!r}::DOUBLE)"


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_TEXT = ["l_returnflag", "l_linestatus"]


def lineitem(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(*LINE, *LINE_TEXT)


def returned(df: DataFrame) -> DataFrame:
    """lineitem with the label `returned`."""
    return df.withColumn("returned", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))


RETURNED_SQL = f"SELECT {', '.join(LINE + LINE_TEXT)}, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS returned FROM lineitem"


def gaps(spark, sf) -> DataFrame:
    """Nulls in a number and a text column."""
    return returned(lineitem(spark, sf)).withColumns(
        {
            "l_quantity": F.when(F.col("l_linenumber") != 3, F.col("l_quantity")),
            "l_returnflag": F.when(F.col("l_linenumber") != 5, F.col("l_returnflag")),
        }
    )


GAPS_SQL = f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN l_linenumber <> 3 THEN l_quantity END AS l_quantity,
       l_extendedprice, l_discount, l_tax,
       CASE WHEN l_linenumber <> 5 THEN l_returnflag END AS l_returnflag, l_linestatus, returned
FROM ({RETURNED_SQL})
"""


def repeats(spark, sf) -> DataFrame:
    """orders, with the finished ones a second and third time."""
    o = table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    done = o.where(F.col("o_orderstatus") == "F")
    return o.unionByName(done).unionByName(done)


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders"
REPEATS_SQL = f"""
{_ORDERS} UNION ALL {_ORDERS} WHERE o_orderstatus = 'F' UNION ALL {_ORDERS} WHERE o_orderstatus = 'F'
"""


def twins(spark, sf) -> DataFrame:
    """Columns that agree on every row, and one that differs on some."""
    return lineitem(spark, sf).withColumns(
        {
            "tax_copy": F.col("l_tax"),
            "tax_near": F.when(F.col("l_linenumber") != 7, F.col("l_tax")),
            "flag_copy": F.col("l_returnflag"),
            "line_as_double": F.col("l_linenumber").cast("double"),
        }
    )


def rare(spark, sf) -> DataFrame:
    """A rare flag, whose quartiles coincide, and a constant."""
    return lineitem(spark, sf).select(*LINE).withColumns(
        {"rare": F.when(F.col("l_quantity") >= 49, 1.0).otherwise(0.0), "const": F.lit(1.0)}
    )


RARE_SQL = f"""
SELECT {', '.join(LINE)}, CASE WHEN l_quantity >= 49 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rare, 1.0::DOUBLE AS const
FROM lineitem
"""

# first hex digit of the draw -> planted text
JUNK = [("0", ""), ("1", "abc"), ("2", "1d"), ("3", " 7 "), ("4", "inf"), ("5", "nan"), ("6", "1e2"), ("7", "-.5")]


def dirty(spark, sf) -> DataFrame:
    """events with the JSON number as text and junk in between."""
    e = table(spark, sf, "events")
    draw = F.substring(digest(SEED, F.col("event_id")), 1, 1)
    junk = F.create_map(*[F.lit(x) for pair in JUNK for x in pair])
    text = F.coalesce(F.try_element_at(junk, draw), F.get_json_object("props", "$.k"))
    return e.select("event_id", "user_id", "event_type", "value", text.alias("k"))


_CASES = " ".join(f"WHEN '{d}' THEN '{t}'" for d, t in JUNK)
DIRTY_SQL = f"""
SELECT event_id, user_id, event_type, value,
       CASE substr({sql_digest('event_id')}, 1, 1) {_CASES} ELSE json_extract_string(props, '$.k') END AS k
FROM events
"""
# what pandas-style parsing makes of the planted texts
NUMBER_SQL = """CASE WHEN trim(k) = '' OR k IN ('abc', '1d', 'nan') THEN NULL
     WHEN k = 'inf' THEN 'inf'::DOUBLE ELSE CAST(trim(k) AS DOUBLE) END"""


def binary_scored(spark, sf) -> DataFrame:
    """events with a 0/1 label and two scores with many ties."""
    y = F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)
    h = digest(SEED, F.col("event_id"))
    return table(spark, sf, "events").select(
        "event_id",
        y.alias("y"),
        F.round(unit(h, 1) * 0.7 + y * 0.2, 3).alias("p"),
        F.round(unit(h, 14) * 0.6 + y * 0.3, 3).alias("p2"),
    )


_Y = "CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
SCORED_SQL = f"""
SELECT event_id, {_Y} AS y,
       round({sql_unit(sql_digest('event_id'), 1)} * 0.7::DOUBLE + {_Y} * 0.2::DOUBLE, 3) AS p,
       round({sql_unit(sql_digest('event_id'), 14)} * 0.6::DOUBLE + {_Y} * 0.3::DOUBLE, 3) AS p2
FROM events
"""

EMBEDDED = [f"f{i}" for i in range(64)]


def vec_minority(spark, sf) -> DataFrame:
    """embeddings, one label against the rest, all coordinates as columns."""
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.when(F.col("label") == 5, 1).otherwise(0).alias("y"),
        *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(EMBEDDED)],
    )


VEC_SQL = f"""
SELECT vec_id, CASE WHEN label = 5 THEN 1 ELSE 0 END AS y,
       {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS {f}' for i, f in enumerate(EMBEDDED))}
FROM embeddings
"""

PLANTED_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def line_key() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax")


def prepared(df: DataFrame) -> DataFrame:
    """Fits read their input many times, so it is written once; planted rows are spread over the cores already."""
    return materialise(df, "prepared")


def planted(spark, sf, spread: bool = True) -> DataFrame:
    """lineitem with a label that depends on the net price, one in ten flipped; `spread` over the cores, at the cost of a shuffle."""
    rows = lineitem(spark, sf)
    df = (widen(rows) if spread else rows).withColumn("row_id", line_key())
    flip = slice_to_long(digest(SEED, F.lit("flip"), F.col("row_id")), 1, 8) / F.lit(float(16**8)) < 0.1
    high = F.col("l_extendedprice") * (1 - F.col("l_discount")) > 60000
    return df.select(
        "row_id", *[F.col(c).cast("double").alias(c) for c in PLANTED_FEATURES],
        F.when(high != flip, 1.0).otherwise(0.0).alias("y"),
    )


# the same rows in SQL; both engines print these doubles alike
_ROW_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax)"
_FLIP = f"{sql_hex(sql_digest("'flip'", _ROW_ID), 1, 8)} / {float(16**8)!r}::DOUBLE < 0.1::DOUBLE"
PLANTED_SQL = f"""
SELECT {_ROW_ID} AS row_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in PLANTED_FEATURES)},
       CASE WHEN (l_extendedprice * (1 - l_discount) > 60000) <> ({_FLIP}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y
FROM lineitem
"""


def parts_sql(rows: str) -> str:
    """(row_id, y, is_test) of the stratified split of (row_id, y) into 60 and 40 percent."""
    return f"""
SELECT row_id, y, rn <= base + CASE WHEN place <= extra THEN 1 ELSE 0 END AS is_test
FROM (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY {sql_digest('row_id')}, row_id) AS rn FROM ({rows})) JOIN (
  SELECT g, base, row_number() OVER (ORDER BY rest DESC, g) AS place, m - sum(base) OVER () AS extra FROM (
    SELECT g, c * m // n AS base, c * m % n AS rest, m FROM (SELECT y AS g, count(*) AS c FROM ({rows}) GROUP BY 1), (
      SELECT CAST(count(*) AS BIGINT) AS n, CAST(ceil(0.4::DOUBLE * CAST(count(*) AS DOUBLE)) AS BIGINT) AS m FROM ({rows})))
) ON y = g
"""
