"""The descriptive report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codebook, report
from . import frames as fr
from .frames import LINE, r


def _label_summary(spark, sf):
    return fr.rounded(report.label_summary(fr.returned(fr.lineitem(spark, sf)), "returned"))


LABEL_SQL = f"""SELECT count(*) AS total, {r('sum(returned)', 'positives')}, {r('sum(returned) / count(*) * 100', 'rate')}
FROM ({fr.RETURNED_SQL})"""

SUMMARISED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "no_such_column"]


def _numeric_summary(spark, sf):
    return fr.rounded(report.numeric_summary(fr.gaps(spark, sf), SUMMARISED), 4)


def _summary_sql(cols: list[str], source: str, digits: int = 4) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'avg({c})', 'mean', digits)}, {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 'median', digits)}, "
        f"{r(f'stddev_samp({c})', 'std', digits)}, {r(f'min({c})', 'min', digits)}, {r(f'max({c})', 'max', digits)} FROM {source}"
        for c in cols
    )


COUNTED = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount"]


def _value_counts(spark, sf):
    return report.value_counts(fr.gaps(spark, sf), [*COUNTED, "no_such_column"])


def _counts_sql(cols: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in cols
    )


COUNTS_SQL = f"WITH g AS ({fr.GAPS_SQL}) " + _counts_sql(COUNTED, "g")


def _value_shares(spark, sf):
    return report.value_shares(_value_counts(spark, sf))


SHARES_SQL = f"""
WITH g AS ({fr.GAPS_SQL}), c AS ({_counts_sql(COUNTED, 'g')})
SELECT feature, value, n, {r('n / sum(n) OVER (PARTITION BY feature) * 100', 'share', 1)} FROM c
"""


def _correlated(spark, sf):
    gaps = fr.gaps(spark, sf)
    return gaps.select(*LINE, "returned").withColumns(
        {"rare": F.when(F.col("l_quantity") >= 49, 1.0).otherwise(0.0), "const": F.lit(1.0)}
    )


def _correlations(spark, sf):
    return fr.rounded(report.label_correlations(_correlated(spark, sf), "returned", 10))


CORR_COLS = [*LINE, "rare", "const"]
CORR_FRAME = f"""SELECT *, CASE WHEN l_quantity >= 49 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rare, 1.0::DOUBLE AS const
FROM ({fr.GAPS_SQL})"""


def _corr_sql(cols: list[str], frame: str, label: str, top: int) -> str:
    each = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CASE WHEN var_pop(CASE WHEN {label} IS NOT NULL THEN {c} END) > 0 "
        f"AND var_pop(CASE WHEN {c} IS NOT NULL THEN {label} END) > 0 THEN abs(corr({c}, {label})) END AS c FROM f"
        for c in cols
    )
    return f"""WITH f AS ({frame}), e AS ({each}),
    k AS (SELECT *, row_number() OVER (ORDER BY c DESC NULLS LAST, feature) AS rn FROM e)
    SELECT feature, {r('c', 'correlation')}, {r('c * 100', 'percent', 1)} FROM k WHERE rn < {top}"""


def _analyze(spark, sf):
    config = report.ReportConfig(
        "returned", ["l_quantity", "l_extendedprice", "l_discount"], ["l_linenumber", "l_tax"], 10
    )
    df = fr.returned(fr.lineitem(spark, sf)).drop("l_returnflag", "l_linestatus")
    return fr.rounded(report.as_long_report(report.analyze(df, config)), 4)


def _analyze_sql() -> str:
    parts = [
        f"SELECT 'label' AS section, '' AS feature, 'total' AS item, CAST(count(*) AS DOUBLE) AS value FROM f",
        f"SELECT 'label', '', 'positives', {r('sum(returned)', digits=4)} FROM f",
        f"SELECT 'label', '', 'rate', {r('sum(returned) / count(*) * 100', digits=4)} FROM f",
    ]
    for c in ["l_quantity", "l_extendedprice", "l_discount"]:
        for item, e in [
            ("mean", f"avg({c})"), ("median", f"quantile_cont({c}, 0.5)"), ("std", f"stddev_samp({c})"),
            ("min", f"min({c})"), ("max", f"max({c})"),
        ]:
            parts.append(f"SELECT 'numeric', '{c}', '{item}', {r(e, digits=4)} FROM f")
    for c in ["l_linenumber", "l_tax"]:
        parts.append(f"SELECT 'values', '{c}', CAST({c} AS VARCHAR), CAST(count(*) AS DOUBLE) FROM f GROUP BY {c}")
    for c in LINE:
        parts.append(f"SELECT 'correlations', '{c}', 'correlation', {r(f'abs(corr({c}, returned))', digits=4)} FROM f")
    return f"WITH f AS ({fr.RETURNED_SQL}) " + " UNION ALL ".join(parts)


def _decode_values(spark, sf):
    book = fr.table(spark, sf, "nation").select(
        F.lit("c_nationkey").alias("feature"), F.col("n_nationkey").cast("double").alias("code"), F.col("n_name").alias("text")
    )
    counts = report.value_counts(
        fr.table(spark, sf, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("double")),
        ["c_nationkey", "c_mktsegment"],
    )
    # the first three codes are given numbers that no customer has
    return codebook.decode_values(counts, book.withColumn("code", F.when(F.col("code") > 2, F.col("code")).otherwise(F.col("code") + 0.5)))


DECODE_SQL = """
WITH c AS (SELECT 'c_nationkey' AS feature, CAST(CAST(c_nationkey AS DOUBLE) AS VARCHAR) AS value, count(*) AS n
           FROM customer GROUP BY c_nationkey
           UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment)
SELECT feature, value, n, coalesce(n_name, value) AS value_text
FROM c LEFT JOIN nation ON feature = 'c_nationkey' AND TRY_CAST(value AS DOUBLE) = n_nationkey AND n_nationkey > 2
"""


def _decode_names(spark, sf):
    names = codebook.name_book(spark, [("c_nationkey", "Nation"), ("c_acctbal", "Balance")])
    counts = report.value_counts(fr.table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"])
    return codebook.decode_names(counts, names)


NAMES_SQL = """
WITH c AS (SELECT 'c_nationkey' AS feature, CAST(c_nationkey AS VARCHAR) AS value, count(*) AS n FROM customer GROUP BY c_nationkey
           UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment)
SELECT feature, value, n, CASE feature WHEN 'c_nationkey' THEN 'Nation' ELSE feature END AS feature_name FROM c
"""


def _documents(spark, sf):
    d = fr.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(fr.table(spark, sf, "labels"), "doc_id")


def _document_report(spark, sf):
    """The report on labelled documents: rate of the label per section."""
    config = report.ReportConfig("toxic", ["n_chars", "quality"], ["lang", "source", "quality"])
    df = _documents(spark, sf)
    parts = {
        "label": report.label_summary(df, "toxic"),
        "numeric": report.numeric_summary(df, config.numeric),
        "values": report.value_shares(report.value_counts(df, config.categorical)),
        "correlations": report.label_correlations(df.select("n_chars", "quality", "toxic"), "toxic"),
    }
    return fr.rounded(report.as_long_report(parts), 4)


def _document_sql() -> str:
    parts = [
        "SELECT 'label' AS section, '' AS feature, 'total' AS item, CAST(count(*) AS DOUBLE) AS value FROM f",
        f"SELECT 'label', '', 'positives', {r('sum(toxic)', digits=4)} FROM f",
        f"SELECT 'label', '', 'rate', {r('sum(toxic) / count(*) * 100', digits=4)} FROM f",
    ]
    for c in ["n_chars", "quality"]:
        for item, e in [
            ("mean", f"avg({c})"), ("median", f"quantile_cont(CAST({c} AS DOUBLE), 0.5)"), ("std", f"stddev_samp({c})"),
            ("min", f"min({c})"), ("max", f"max({c})"),
        ]:
            parts.append(f"SELECT 'numeric', '{c}', '{item}', {r(e, digits=4)} FROM f")
    for c in ["lang", "source", "quality"]:
        parts.append(f"SELECT 'values', '{c}', CAST({c} AS VARCHAR), CAST(count(*) AS DOUBLE) FROM f GROUP BY {c}")
    for c in ["n_chars", "quality"]:
        parts.append(f"SELECT 'correlations', '{c}', 'correlation', {r(f'abs(corr({c}, toxic))', digits=4)} FROM f")
    return (
        "WITH f AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)) "
        + " UNION ALL ".join(parts)
    )


QUERIES = {
    "label_summary": (_label_summary, LABEL_SQL),
    "numeric_summary": (_numeric_summary, f"WITH g AS ({fr.GAPS_SQL}) " + _summary_sql(SUMMARISED[:-1], "g")),
    "value_counts": (_value_counts, COUNTS_SQL),
    "value_shares": (_value_shares, SHARES_SQL),
    "label_correlations": (_correlations, _corr_sql(CORR_COLS, CORR_FRAME, "returned", 10)),
    "analyze": (_analyze, _analyze_sql()),
    "document_report": (_document_report, _document_sql()),
    "decode_values": (_decode_values, DECODE_SQL),
    "decode_names": (_decode_names, NAMES_SQL),
}
