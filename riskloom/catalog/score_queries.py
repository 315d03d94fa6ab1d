"""Sources, scoring, rules, checks and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import digest, unit
from ..operators import evaluate, features, packs, rules, score, split, train
from ..operators.features import Derived
from ..operators.importance import importance_rows, selected_names, importance_table
from ..operators.scale import RobustScale
from ..plans.durable import fresh_path
from ..sources import bundles, tables
from ..streaming import scoring
from . import frames as fr
from .frames import r, sql_digest, sql_unit

TEXTS = {1: "at risk", 0: "no risk"}
FALLBACK = "keep going"


# --- sources -------------------------------------------------------------

def _csv_source(spark, sf):
    """orders with several spellings of "missing", through a header CSV and type inference."""
    path = fresh_path(spark, "orders-csv")
    o = fr.table(spark, sf, "orders")
    tables.write_table(
        o.select(
            "o_orderkey",
            F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("N/A")).otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
            F.when(F.col("o_orderstatus") == "F", F.lit("null")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
            F.when(F.col("o_orderstatus") == "P", F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
            "o_orderpriority",
        ),
        path,
    )
    return tables.read_table(spark, path)


CSV_SQL = """
SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(o_custkey AS DOUBLE) END AS o_custkey,
       CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice, o_orderpriority
FROM orders
"""


def _csv_schema(spark, sf):
    """The same with a given schema, in one pass."""
    path = fresh_path(spark, "part-csv")
    tables.write_table(fr.table(spark, sf, "part"), path)
    return tables.read_table(
        spark, path, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    )


def _csv_split(spark, sf):
    """Whole texts with their line breaks, through a quoted CSV that is read in ranges."""
    path = fresh_path(spark, "documents-csv")
    docs = fr.table(spark, sf, "documents").select("doc_id", "lang", F.concat(F.lit("text: "), F.col("text")).alias("text"))
    docs.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreTrailingWhiteSpace", False).csv(path)
    read = tables.read_table(spark, path, "doc_id bigint, lang string, text string", "csv", multi_line="split")
    return read.select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


CSV_SPLIT_SQL = """
SELECT doc_id, nullif(lang, '') AS lang, CAST(length('text: ' || text) AS BIGINT) AS n_chars, md5('text: ' || text) AS text_md5 FROM documents
"""


def _parquet_source(spark, sf):
    path = fresh_path(spark, "events-parquet")
    e = fr.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "view", F.lit(float("nan"))).otherwise(F.col("value")).alias("value")
    )
    tables.write_table(e, path, "parquet")
    return tables.read_table(spark, path, format="parquet")


PARQUET_SQL = "SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS value FROM events"


def _records_text(spark, sf):
    """One JSON text per event; some fields are left out, some are empty."""
    d = fr.dirty(spark, sf)
    k = F.when(F.col("event_type") != "click", F.col("k"))
    return d.select(
        "event_id", F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k"), F.col("value"))).alias("value")
    )


def _json_source(spark, sf):
    path = fresh_path(spark, "events-json")
    _records_text(spark, sf).select("value").write.text(path)
    got = tables.read_records(spark, path, ["id", "k", "value", "absent"])
    return got.withColumn("present", F.concat_ws(",", F.array_sort("present")))


JSON_SQL = f"""
WITH d AS (SELECT *, CASE WHEN event_type <> 'click' THEN k END AS kk FROM ({fr.DIRTY_SQL}))
SELECT CAST(event_id AS VARCHAR) AS id, kk AS k, CAST(value AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS absent,
       CASE WHEN kk IS NULL THEN 'id,value' ELSE 'id,k,value' END AS present, true AS has_data
FROM d
"""


# --- scoring -------------------------------------------------------------

def _coerce_raw(spark, sf):
    return fr.rounded(score.coerce_raw(fr.dirty(spark, sf).select("event_id", "k", "value"), ["k", "value"]))


RAW_NUMBER_SQL = """CASE WHEN trim(k) IN ('', 'abc', '1d') OR k IS NULL THEN 0.0::DOUBLE WHEN k = 'nan' THEN 'nan'::DOUBLE
       WHEN k = 'inf' THEN 'inf'::DOUBLE ELSE CAST(trim(k) AS DOUBLE) END"""


def _finite_raw(spark, sf):
    """Raw text to finite numbers, as a model takes them."""
    raw = score.coerce_raw(fr.dirty(spark, sf).select("event_id", "k", "value"), ["k", "value"])
    return fr.rounded(features.finite_or_zero(raw, ["k", "value"]))


FINITE_RAW_SQL = f"""
SELECT event_id, {r(f"CASE WHEN k IN ('nan', 'inf') THEN 0.0::DOUBLE ELSE {RAW_NUMBER_SQL} END", 'k')}, {r('value', 'value')}
FROM ({fr.DIRTY_SQL})
"""


def _decided(spark, sf):
    h = digest(fr.SEED, F.col("event_id"))
    df = fr.dirty(spark, sf).withColumn("probability", unit(h, 1))
    return score.decide(df, "probability", 0.43)


def _decide(spark, sf):
    return fr.rounded(_decided(spark, sf).select("event_id", "probability", "prediction", "confidence"))


_P = sql_unit(sql_digest("event_id"))
DECIDE_SQL = f"""
SELECT event_id, {r(_P, 'probability')}, CASE WHEN {_P} >= 0.43::DOUBLE THEN 1 ELSE 0 END AS prediction,
       {r(f'abs({_P} - 0.5) * 2', 'confidence')}
FROM events
"""


def _label_result(spark, sf):
    return score.label_result(_decided(spark, sf), TEXTS).select("event_id", "prediction", "result_text")


RESULT_SQL = f"""
SELECT event_id, CASE WHEN {_P} >= 0.43::DOUBLE THEN 1 ELSE 0 END AS prediction,
       CASE WHEN {_P} >= 0.43::DOUBLE THEN 'at risk' ELSE 'no risk' END AS result_text
FROM events
"""

LINE_RULES = [
    rules.Rule("prediction", "=", 1, "discounted"),
    rules.Rule("l_quantity", ">", 25, "large"),
    rules.Rule("l_linenumber", "=", 1, "first"),
    rules.Rule("l_tax", "=", 0, "untaxed"),
    rules.Rule("l_suppkey", "<", 3, "early supplier"),
]


def _apply_rules(spark, sf):
    df = fr.gaps(spark, sf).withColumn("prediction", (F.col("l_discount") >= 0.05).cast("int"))
    told = rules.apply_rules(df, LINE_RULES, FALLBACK)
    return told.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.concat_ws("|", "recommendations").alias("recommendations")
    )


def _rules_sql(cases: list[str], fallback: str) -> str:
    listed = ", ".join(cases)
    return f"CASE WHEN concat_ws('|', {listed}) = '' THEN '{fallback}' ELSE concat_ws('|', {listed}) END AS recommendations"


RULES_SQL = f"""
SELECT l_orderkey, l_linenumber, l_partkey, {_rules_sql([
    "CASE WHEN l_discount >= 0.05::DOUBLE THEN 'discounted' END", "CASE WHEN l_quantity > 25 THEN 'large' END",
    "CASE WHEN l_linenumber = 1 THEN 'first' END", "CASE WHEN l_tax = 0 THEN 'untaxed' END",
    "CASE WHEN l_suppkey < 3 THEN 'early supplier' END"], FALLBACK)}
FROM ({fr.GAPS_SQL})
"""

EVENT_RULES = [
    rules.Rule("prediction", "=", 1, "see someone"),
    rules.Rule("k", ">", 60, "k is high"),
    rules.Rule("value", ">", 80, "value is high"),
    rules.Rule("k", "=", 0, "k is zero"),
    rules.Rule("nowhere", "=", 0, "nowhere is zero"),
]
_EVENT_ADVICE = _rules_sql(
    [
        f"CASE WHEN {_P} >= 0.43::DOUBLE THEN 'see someone' END",
        "CASE WHEN k > 60 AND NOT isnan(k) THEN 'k is high' END",
        "CASE WHEN value > 80 THEN 'value is high' END",
        "CASE WHEN k = 0 THEN 'k is zero' END",
        "'nowhere is zero'",
    ],
    FALLBACK,
)


def _response(df, *more):
    h = digest(fr.SEED, F.col("event_id"))
    numbers = score.coerce_raw(df, ["k", "value"])
    decided = score.decide(numbers.withColumn("probability", unit(h, 1)), "probability", 0.43)
    told = rules.apply_rules(score.label_result(decided, TEXTS), EVENT_RULES, FALLBACK)
    return told.select(
        "event_id", "prediction", "probability", "confidence", "result_text",
        F.concat_ws("|", "recommendations").alias("recommendations"), *more,
    )


def _bad_lines(spark, sf):
    """All events as JSON lines, a part of them empty, without fields, cut off or null."""
    d = fr.dirty(spark, sf)
    draw, line = F.substring(digest(fr.SEED, F.col("event_id")), 2, 1), F.to_json(F.struct("event_id", "k", "value"))
    text = F.when(draw == "0", "").when(draw == "1", "{}").when(draw == "2", F.expr("left(line, 9)")).when(draw == "3", "null")
    return d.withColumn("line", line).select("event_id", text.otherwise(F.col("line")).alias("value"))


_EVENT_ANSWERS = ["prediction", "probability", "confidence", "result_text", "recommendations"]


def _rejected(spark, sf):
    """Answers for good lines, a reason for the others."""
    records = tables.records_from(_bad_lines(spark, sf).withColumnRenamed("event_id", "id"), ["k", "value"]).withColumnRenamed("id", "event_id")
    return fr.rounded(score.reject_empty(_response(records, "has_data"), _EVENT_ANSWERS).drop("has_data"))


def _rejected_stream(spark, sf):
    """The same lines as they arrive: bad ones have no id, so they are counted."""
    source, sink = fresh_path(spark, "mixed"), fresh_path(spark, "mixed-answers")
    _bad_lines(spark, sf).select("value").repartition(4).write.text(source)
    stream = scoring.record_stream(spark, source, ["event_id", "k", "value"], max_files=2)
    told = score.reject_empty(_response(stream, "has_data"), _EVENT_ANSWERS)
    scoring.write_stream(told, sink, fresh_path(spark, "mixed-log")).awaitTermination()
    return spark.read.parquet(sink).groupBy("error", "prediction").agg(F.count("*").alias("n"))


_BAD = f"substr({sql_digest('event_id')}, 2, 1) IN ('0', '1', '2', '3')"


def _score_response(spark, sf):
    return fr.rounded(_response(fr.dirty(spark, sf)))


RESPONSE_SQL = f"""
WITH d AS (SELECT event_id, value, {RAW_NUMBER_SQL} AS k FROM ({fr.DIRTY_SQL}))
SELECT event_id, CASE WHEN {_P} >= 0.43::DOUBLE THEN 1 ELSE 0 END AS prediction, {r(_P, 'probability')},
       {r(f'abs({_P} - 0.5) * 2', 'confidence')},
       CASE WHEN {_P} >= 0.43::DOUBLE THEN 'at risk' ELSE 'no risk' END AS result_text, {_EVENT_ADVICE}
FROM d
"""


REJECTED_SQL = f"""
SELECT event_id, {', '.join(f'CASE WHEN NOT {_BAD} THEN {c} END AS {c}' for c in _EVENT_ANSWERS)},
       CASE WHEN {_BAD} THEN 'no data' END AS error
FROM ({RESPONSE_SQL})
"""
REJECTED_STREAM_SQL = f"SELECT error, prediction, count(*) AS n FROM ({REJECTED_SQL}) GROUP BY ALL"


def _stream_response(spark, sf):
    """All events as arriving JSON records; the answers are the batch answers."""
    source = fresh_path(spark, "arriving")
    d = fr.dirty(spark, sf)
    d.select(F.to_json(F.struct("event_id", "k", "value")).alias("value")).repartition(4).write.text(source)
    stream = scoring.record_stream(spark, source, ["event_id", "k", "value"], max_files=2)
    sink = fresh_path(spark, "answers")
    query = scoring.write_stream(_response(stream), sink, fresh_path(spark, "answers-log"))
    query.awaitTermination()
    return fr.rounded(spark.read.parquet(sink).withColumn("event_id", F.col("event_id").cast("long")))


CHECKS = [
    rules.Constraint("value", low=1, high=200),
    rules.Constraint("k", low=0, high=90),
    rules.Constraint("user_id", codes=tuple(range(1, 41))),
]


def _validate(spark, sf):
    checked = rules.validate(fr.dirty(spark, sf), CHECKS)
    return checked.select("event_id", F.concat_ws("|", "violations").alias("violations"))


_K_OK = f"coalesce(({fr.NUMBER_SQL}) BETWEEN 0 AND 90, false)"
_VIOLATIONS = f"""concat_ws('|', CASE WHEN value NOT BETWEEN 1 AND 200 THEN 'value: range' END,
    CASE WHEN trim(k) = '' THEN 'k: missing' END,
    CASE WHEN trim(k) <> '' AND NOT {_K_OK} THEN 'k: range' END,
    CASE WHEN user_id NOT BETWEEN 1 AND 40 THEN 'user_id: code' END)"""
VALIDATE_SQL = f"SELECT event_id, {_VIOLATIONS} AS violations FROM ({fr.DIRTY_SQL})"


def _violation_counts(spark, sf):
    return rules.violation_counts(rules.validate(fr.dirty(spark, sf), CHECKS))


VIOLATION_SQL = f"""
WITH v AS (SELECT unnest(string_split({_VIOLATIONS}, '|')) AS violation FROM ({fr.DIRTY_SQL}))
SELECT violation, count(*) AS n FROM v WHERE violation <> '' GROUP BY 1
"""


# --- with a fitted model -------------------------------------------------

SPECS = [Derived("price_quantity", "product", ("l_extendedprice", "l_quantity")), Derived("tax_squared", "square", ("l_tax",), "omit")]


def make_bundle(spark, sf) -> bundles.Bundle:
    df = fr.prepared(features.derive(fr.planted(spark, sf), SPECS))
    names = [*fr.PLANTED_FEATURES, "price_quantity", "tax_squared"]
    parts = split.stratified_split(df, "y", "row_id")
    fit, test = parts.where(~F.col("is_test")), parts.where("is_test")
    first = packs.fit(train.forest("y", {"numTrees": 10, "maxDepth": 4}), train.training_frame(fit, names, "y"))
    values = first.featureImportances.toArray()
    chosen = selected_names(importance_table(spark, names, values))
    scaler = RobustScale.fit(fit, chosen)
    scaled = scaler.transform(fit)
    model = train.fit_gbt(scaled, chosen, "y", {"maxIter": 5, "maxDepth": 4})
    scored = train.predict_proba(model, scaler.transform(test), chosen, "p")
    best = evaluate.best_threshold(evaluate.threshold_sweep(scored, "p", "y")).first()
    metadata = {
        "best_model_name": "gbt", "optimal_threshold": best.t, "best_score": best.combined, "accuracy": best.acc,
        "f1_score": best.f1, "selected_features_count": len(chosen), "total_features_count": len(names),
    }
    return bundles.Bundle(model, scaler, chosen, importance_rows(names, values), metadata, {"maxIter": 5, "maxDepth": 4})


def _reloaded(spark, sf):
    path = fresh_path(spark, "bundle")
    bundles.save_bundle(spark, make_bundle(spark, sf), path)
    return bundles.load_bundle(spark, path)


def _score(spark, sf):
    df = fr.planted(spark, sf)
    """Every row has a chance, and prediction and confidence follow from it."""
    bundle = make_bundle(spark, sf)
    p = F.col("probability")
    return score.score(df, bundle, SPECS).select(
        "row_id", "y", p.between(0.0, 1.0).alias("is_chance"),
        ((F.col("prediction") == 1) == (p >= bundle.threshold)).alias("follows"),
        F.round(F.abs(p - 0.5) * 2 - F.col("confidence"), 9).alias("difference"),
    )


SCORE_SQL = f"SELECT row_id, y, true AS is_chance, true AS follows, 0.0::DOUBLE AS difference FROM ({fr.PLANTED_SQL})"


def _bundle(spark, sf):
    """A saved and reloaded bundle scores every row as before."""
    path, first = fresh_path(spark, "bundle"), make_bundle(spark, sf)
    bundles.save_bundle(spark, first, path)
    once = score.score(fr.planted(spark, sf), first, SPECS).withColumnsRenamed({c: f"_{c}" for c in ("prediction", "probability", "confidence")})
    twice = score.score(once, bundles.load_bundle(spark, path), SPECS)
    same = F.col("probability") == F.col("_probability")
    return twice.select("row_id", same.alias("same_chance"), (F.col("prediction") == F.col("_prediction")).alias("same_prediction"))


BUNDLE_SQL = f"SELECT row_id, true AS same_chance, true AS same_prediction FROM ({fr.PLANTED_SQL})"


RECORD_RULES = [
    rules.Rule("prediction", "=", 1, "high price expected"),
    rules.Rule("l_quantity", ">", 25, "large"),
    rules.Rule("l_tax", "=", 0, "untaxed"),
]
RECORD_FIELDS = ["row_id", *fr.PLANTED_FEATURES]


def _record_text(spark, sf):
    """lineitem as JSON records; one field is sometimes left out."""
    df = fr.planted(spark, sf, spread=False).withColumn("l_tax", F.when(F.col("l_linenumber") != 2, F.col("l_tax")))
    return df.select(F.to_json(F.struct(*RECORD_FIELDS)).alias("value"))


def _answers(df, bundle):
    told = score.score_report(
        df, bundle, RECORD_RULES, FALLBACK, TEXTS, SPECS, raw=fr.PLANTED_FEATURES, present="present"
    )
    return told.select(
        "row_id", "prediction", "probability", "confidence", "result_text",
        F.concat_ws("|", "recommendations").alias("recommendations"), F.to_json("feature_importance").alias("feature_importance"),
    )


def _score_report(spark, sf):
    records = tables.read_records(spark, _record_text(spark, sf), RECORD_FIELDS)
    told = _answers(records, make_bundle(spark, sf))
    advised = F.split("recommendations", r"\|")
    return told.select(
        "row_id", (F.col("prediction") == (F.col("result_text") == TEXTS[1]).cast("int")).alias("text_follows"),
        ((F.col("prediction") == 1) == F.array_contains(advised, RECORD_RULES[0].text)).alias("advice_follows"),
        F.concat_ws("|", F.filter(advised, lambda a: ~a.isin(RECORD_RULES[0].text, FALLBACK))).alias("advice"),
        F.size(F.from_json("feature_importance", "map<string,double>")).alias("n_features"),
    )


REPORT_SQL = f"""
SELECT row_id, true AS text_follows, true AS advice_follows, 5 AS n_features,
       concat_ws('|', CASE WHEN l_quantity > 25 THEN 'large' END, CASE WHEN l_tax = 0 OR l_linenumber = 2 THEN 'untaxed' END) AS advice
FROM ({fr.PLANTED_SQL})
"""


#: Records of one file that the stream reads, and rows of one part of the join with the batch's answers.
FILE_RECORDS, JOIN_ROWS = 1_000_000, 500_000


def _score_stream(spark, sf):
    source, sink = fresh_path(spark, "records"), fresh_path(spark, "scored")
    texts = _record_text(spark, sf)
    if texts.rdd.getNumPartitions() < 4:  # a small table; a large one is not shuffled
        texts = texts.repartition(4)
    # a compressed file is one task, hence its bound
    texts.write.option("maxRecordsPerFile", FILE_RECORDS).text(source, compression="snappy")
    n_files = len(spark.read.text(source).inputFiles())
    stream, bundle = scoring.record_stream(spark, source, RECORD_FIELDS, max_files=(n_files + 1) // 2), make_bundle(spark, sf)
    told = scoring.score_stream(
        stream, bundle, RECORD_RULES, FALLBACK, TEXTS, SPECS, raw=fr.PLANTED_FEATURES, present="present"
    )
    told = told.select("row_id", "probability", "result_text", "error")
    scoring.write_stream(told, sink, fresh_path(spark, "scored-log")).awaitTermination()
    records = tables.read_records(spark, _record_text(spark, sf), RECORD_FIELDS)
    batch = _answers(records, bundle).select("row_id", F.col("probability").alias("_p"), F.col("result_text").alias("_text"))
    scored = spark.read.parquet(sink)
    # parts that are sorted in memory, without spills
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), scored.count() // JOIN_ROWS + 1)
    return scored.repartition(n, "row_id").join(batch.repartition(n, "row_id"), "row_id").select(
        "row_id", "error", (F.col("probability") == F.col("_p")).alias("same_chance"), (F.col("result_text") == F.col("_text")).alias("same_text")
    )


STREAM_SQL = f"SELECT row_id, CAST(NULL AS VARCHAR) AS error, true AS same_chance, true AS same_text FROM ({fr.PLANTED_SQL})"


def _model_info(spark, sf):
    info = score.model_info(spark, _reloaded(spark, sf))
    return info.select(
        "model_name", F.size("selected_features").alias("n_selected"), "total_features", "selected_features_count",
        F.array_contains("selected_features", "l_extendedprice").alias("price_selected"),
        F.col("optimal_threshold").between(0.1, 0.9).alias("on_grid"), (F.col("accuracy") >= 0.75).alias("good"),
    )


INFO_SQL = """
SELECT 'gbt' AS model_name, 5 AS n_selected, 7 AS total_features, 5 AS selected_features_count,
       count(*) > 0 AS price_selected, true AS on_grid, true AS good FROM lineitem
"""


QUERIES = {
    "read_csv": (_csv_source, CSV_SQL),
    "read_csv_schema": (_csv_schema, "SELECT * FROM part"),
    "read_csv_split": (_csv_split, CSV_SPLIT_SQL),
    "read_parquet": (_parquet_source, PARQUET_SQL),
    "read_records": (_json_source, JSON_SQL),
    "coerce_raw": (_coerce_raw, f"SELECT event_id, {RAW_NUMBER_SQL} AS k, {r('value', 'value')} FROM ({fr.DIRTY_SQL})"),
    "coerce_raw_finite": (_finite_raw, FINITE_RAW_SQL),
    "decide": (_decide, DECIDE_SQL),
    "label_result": (_label_result, RESULT_SQL),
    "apply_rules": (_apply_rules, RULES_SQL),
    "score_response": (_score_response, RESPONSE_SQL),
    "stream_response": (_stream_response, RESPONSE_SQL),
    "validate": (_validate, VALIDATE_SQL),
    "violation_counts": (_violation_counts, VIOLATION_SQL),
    "rejected_records": (_rejected, REJECTED_SQL),
    "rejected_stream": (_rejected_stream, REJECTED_STREAM_SQL),
    "score": (_score, SCORE_SQL),
    "bundle_round_trip": (_bundle, BUNDLE_SQL),
    "score_report": (_score_report, REPORT_SQL),
    "score_stream": (_score_stream, STREAM_SQL),
    "model_info": (_model_info, INFO_SQL),
}
