"""Profiling and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, profile
from . import frames as fr
from .frames import LINE, r

ALL_GAPS = [*LINE, "l_returnflag", "l_linestatus", "returned"]


def _null_counts(spark, sf):
    return profile.null_counts(fr.gaps(spark, sf))


def _numeric_null_counts(spark, sf):
    df = fr.gaps(spark, sf)
    return profile.null_counts(df, profile.numeric_columns(df, ["returned"]))


def _counts_sql(cols: list[str]) -> str:
    return f"WITH g AS ({fr.GAPS_SQL}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null FROM g" for c in cols
    )


def _impute_median(spark, sf):
    df = fr.gaps(spark, sf)
    return clean.impute_median(df, profile.numeric_columns(df))


IMPUTE_MEDIAN_SQL = f"""
WITH g AS ({fr.GAPS_SQL}), m AS (SELECT quantile_cont(l_quantity, 0.5) AS q FROM g)
SELECT g.* REPLACE (coalesce(g.l_quantity, m.q) AS l_quantity) FROM g, m
"""


def _impute_mode(spark, sf):
    return clean.impute_mode(fr.gaps(spark, sf))


IMPUTE_MODE_SQL = f"""
WITH g AS ({fr.GAPS_SQL}),
m AS (SELECT l_returnflag AS v FROM g WHERE l_returnflag IS NOT NULL
      GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT g.* REPLACE (coalesce(g.l_returnflag, m.v) AS l_returnflag) FROM g, m
"""


def _drop_rows(spark, sf):
    return clean.drop_duplicate_rows(fr.repeats(spark, sf))


def _pairs(spark, sf):
    return clean.duplicate_column_pairs(fr.twins(spark, sf), ["l_returnflag"])


def _pairs_all(spark, sf):
    return clean.duplicate_column_pairs(fr.twins(spark, sf))


def _pair_sql(exclude: tuple[str, ...] = ()) -> str:
    """Compare every pair of one type, value by value."""
    frame = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
        l_returnflag, l_linestatus, l_tax AS tax_copy, CASE WHEN l_linenumber <> 7 THEN l_tax END AS tax_near,
        l_returnflag AS flag_copy, CAST(l_linenumber AS DOUBLE) AS line_as_double FROM lineitem"""
    types = [
        ["l_orderkey", "l_partkey", "l_suppkey"],
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "tax_copy", "tax_near", "line_as_double"],
        ["l_returnflag", "l_linestatus", "flag_copy"],
    ]
    tests = [
        (a, b) for g in types for i, a in enumerate(g) for b in g[i + 1 :] if a not in exclude and b not in exclude
    ]
    return f"WITH t AS ({frame}) SELECT left_column, right_column FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS left_column, '{b}' AS right_column, bool_and({a} IS NOT DISTINCT FROM {b}) AS eq FROM t"
        for a, b in tests
    ) + ") WHERE eq"


def _drop_columns(spark, sf):
    return clean.drop_duplicate_columns(fr.twins(spark, sf), ["flag_copy"])


DROP_COLUMNS_SQL = f"""
SELECT {', '.join(LINE)}, l_returnflag, l_linestatus, CASE WHEN l_linenumber <> 7 THEN l_tax END AS tax_near,
       l_returnflag AS flag_copy, CAST(l_linenumber AS DOUBLE) AS line_as_double
FROM lineitem
"""

FENCED = ["value", "user_id"]


def _iqr_bounds(spark, sf):
    parts = clean.iqr_bounds(fr.table(spark, sf, "events"), FENCED)
    more = clean.iqr_bounds(fr.rare(spark, sf), [*LINE, "rare", "const"])
    return fr.rounded(parts.unionByName(more))


def _bounds_sql(cols: list[str], source: str) -> str:
    def one(c: str) -> str:
        q = f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b FROM {source})"
        return (
            f"SELECT '{c}' AS \"column\", {r('a', 'q1')}, {r('b', 'q3')}, {r('b - a', 'iqr')}, "
            f"{r('a - 1.5 * (b - a)', 'lower')}, {r('b + 1.5 * (b - a)', 'upper')} FROM {q}"
        )

    return " UNION ALL ".join(one(c) for c in cols)


IQR_SQL = _bounds_sql(FENCED, "events") + " UNION ALL " + _bounds_sql([*LINE, "rare", "const"], f"({fr.RARE_SQL})")


def _clip(spark, sf):
    df = fr.table(spark, sf, "events").select("event_id", "value")
    df = df.withColumn("holes", F.when(F.col("value") > 5, F.col("value")))
    return fr.rounded(clean.clip(df, clean.iqr_bounds(df, ["value", "holes"])))


def _clip_sql(expr: str, name: str) -> str:
    return r(f"CASE WHEN {expr} IS NOT NULL THEN greatest({name}_lo, least({name}_hi, {expr})) END", name)


CLIP_SQL = f"""
WITH e AS (SELECT event_id, value, CASE WHEN value > 5 THEN value END AS holes FROM events),
q AS (SELECT quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b,
             quantile_cont(holes, 0.25) c, quantile_cont(holes, 0.75) d FROM e),
k AS (SELECT a - 1.5 * (b - a) value_lo, b + 1.5 * (b - a) value_hi,
             c - 1.5 * (d - c) holes_lo, d + 1.5 * (d - c) holes_hi FROM q)
SELECT event_id, {_clip_sql('value', 'value')}, {_clip_sql('holes', 'holes')} FROM e, k
"""


def _clip_skip(spark, sf):
    df = fr.rare(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "rare", "l_extendedprice")
    bounds = clean.iqr_bounds(df, ["rare", "l_extendedprice"])
    return fr.rounded(clean.clip(df, bounds, skip_zero_iqr=True))


CLIP_SKIP_SQL = f"""
WITH e AS ({fr.RARE_SQL}),
q AS (SELECT quantile_cont(l_extendedprice, 0.25) a, quantile_cont(l_extendedprice, 0.75) b FROM e)
SELECT l_orderkey, l_linenumber, l_partkey, {r('rare', 'rare')},
       {r('greatest(a - 1.5 * (b - a), least(b + 1.5 * (b - a), l_extendedprice))', 'l_extendedprice')}
FROM e, q
"""


def _coerce_numeric(spark, sf):
    return fr.rounded(clean.coerce_numeric(fr.dirty(spark, sf).select("event_id", "k"), ["k"]))


COERCE_SQL = f"""
WITH d AS ({fr.DIRTY_SQL}), n AS (SELECT event_id, {fr.NUMBER_SQL} AS k FROM d),
m AS (SELECT quantile_cont(k, 0.5) AS q FROM n)
SELECT event_id, {r('coalesce(n.k, m.q)', 'k')} FROM n, m
"""


def messy(spark, sf):
    """Gaps, copies of rows and of a column, and a text column of numbers with junk."""
    df = fr.gaps(spark, sf).withColumns(
        {
            "tax_copy": F.col("l_tax"),
            "code_text": F.when(F.col("l_linenumber") == 1, F.lit("x")).otherwise(
                F.concat(F.lit(" "), (F.col("l_suppkey") % 10).cast("string"))
            ),
        }
    )
    return df.unionByName(df.where(F.col("l_linestatus") == "F"))


_MESSY = f"""SELECT *, l_tax AS tax_copy,
    CASE WHEN l_linenumber = 1 THEN 'x' ELSE ' ' || CAST(l_suppkey % 10 AS VARCHAR) END AS code_text FROM ({fr.GAPS_SQL})"""
_CLIPPED = ", ".join(
    r(f"greatest(q1_{c} - 1.5 * (q3_{c} - q1_{c}), least(q3_{c} + 1.5 * (q3_{c} - q1_{c}), {c}))", c) for c in LINE
)
CLEAN_SQL = f"""
WITH g AS (SELECT * FROM ({_MESSY}) UNION ALL SELECT * FROM ({_MESSY}) WHERE l_linestatus = 'F'),
med AS (SELECT quantile_cont(l_quantity, 0.5) AS q FROM g),
mo AS (SELECT l_returnflag AS v FROM g WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
u AS (SELECT DISTINCT g.* REPLACE (coalesce(l_quantity, q) AS l_quantity, coalesce(l_returnflag, v) AS l_returnflag)
      FROM g, med, mo),
b AS (SELECT {', '.join(f'quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1_{c}, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3_{c}' for c in LINE)} FROM u),
n AS (SELECT *, TRY_CAST(trim(code_text) AS DOUBLE) AS code FROM u),
cm AS (SELECT quantile_cont(code, 0.5) AS m FROM n)
SELECT {_CLIPPED}, CAST(NULL AS DOUBLE) AS l_returnflag, CAST(NULL AS DOUBLE) AS l_linestatus, returned,
       {r('coalesce(code, m)', 'code_text')}
FROM n, b, cm
"""


def _clean_table(spark, sf):
    return fr.rounded(clean.clean_table(messy(spark, sf), "returned"))


QUERIES = {
    "null_counts": (_null_counts, _counts_sql(ALL_GAPS)),
    "numeric_null_counts": (_numeric_null_counts, _counts_sql(LINE)),
    "impute_median": (_impute_median, IMPUTE_MEDIAN_SQL),
    "impute_mode": (_impute_mode, IMPUTE_MODE_SQL),
    "drop_duplicate_rows": (_drop_rows, f"SELECT DISTINCT * FROM ({fr.REPEATS_SQL})"),
    "duplicate_column_pairs": (_pairs_all, _pair_sql()),
    "duplicate_column_pairs_label_excluded": (_pairs, _pair_sql(("l_returnflag",))),
    "drop_duplicate_columns": (_drop_columns, DROP_COLUMNS_SQL),
    "iqr_bounds": (_iqr_bounds, IQR_SQL),
    "clip": (_clip, CLIP_SQL),
    "clip_skip_zero_iqr": (_clip_skip, CLIP_SKIP_SQL),
    "coerce_numeric": (_coerce_numeric, COERCE_SQL),
    "clean_table": (_clean_table, CLEAN_SQL),
}
