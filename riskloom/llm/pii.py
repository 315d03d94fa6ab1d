"""Personal data in texts, in DataFrame functions only.

Fixed patterns with checks give the base spans. Beside them, generators of high
recall propose further, overlapping candidate spans. Boosted trees (Spark
MLlib) score a candidate by features of its format and context. They learn from
a bounded sample. Positives are base spans as they look in a format that the
base patterns miss (no plus, other separators, "(at)"), and candidates with
evidence of their own: the shape of their kind, a card's checksum, for phones a
word before. Negatives are candidates that have neither the shape nor a word
before and touch no base span. All others are not learned from, but scored. Per
kind, the threshold is the lowest at which held-out examples above it are
positive to the share `PRECISION`. Candidates with evidence or above the
threshold that touch no base span are added.

Everything about a text happens in its own row, by array functions: nothing is
shuffled, and the trees are evaluated as an expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import quoted
from ..plans.durable import materialise, use_shared_checkpoints

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS = 20_000
ROUNDS = 10
DEPTH = 4
PRECISION = 0.99
CELLS = 500

# Possessive forms of the base patterns: the same matches, without backtracking
# and, by the look-behind, without a new try at each letter of a long run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATES = {
    "email": r"(?:\G|(?<![^\s@<>(),;:\x22]))[^\s@<>(),;:\x22]++(?:@|\x20?[\[(](?i:at)[\])]\x20?)[^\s@<>(),;:\x22]++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:(?:\.|\[\.\]|,)[0-9]++)++",
    "card": r"[0-9](?:[\x20./-]?[0-9])++",
    "phone": r"[+(]?[0-9](?:[\x20()./-]{0,3}+[0-9])++",
}
LEAST_LENGTH = {"email": 5, "ip": 7, "card": 12, "phone": 7}
WORDS = {
    "email": "(?i)mail|contact|write|@", "ip": "(?i)ip|host|addr|server", "card": "(?i)card|visa|pay|credit", "phone": "(?i)tel|phone|call|fax|mobil",
}
FEATURES = (
    "kind_no", "n", "digits", "letters", "marks", "groups", "plus", "brackets", "spaces", "dots", "checksum", "small_parts", "first_digit",
    "before_letter", "before_space", "after_letter", "after_space", "after_digit", "word_before", "shape",
)
# Forms that personal data is written in, the base ones among them; the checks on digits come on top.
# All repeats are bounded, since the candidates are not.
SHAPES = {
    "email": r"^(?=.{5,320}$)[\p{L}0-9._%+-]++(?:@|\x20?[\[(](?i:at)[\])]\x20?)[\p{L}0-9-]+(?:\.[\p{L}0-9-]+){0,20}\.\p{L}{2,}\W*$",
    "ip": r"^[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3}$",
    "card": r"^[0-9]{4,19}(?:[\x20./-][0-9]{2,7}){0,6}$",
    "phone": r"^\+|^[0-9\x20.-]{0,5}\([0-9]{1,5}\)|^0[0-9]{1,4}(?:[\x20./-]{1,3}[0-9]{2,8}){1,6}$|^(?:1[\x20.-])?[2-9][0-9]{2}[\x20.-][0-9]{3}[\x20.-][0-9]{4}$",
}
DATE = r"^[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}(?![0-9])"
JOINED_BEFORE, JOINED_AFTER = r"(?:[\p{L}_]|[0-9][.,:/-]?)$", r"^(?:[\p{L}_]|[.,:/-]?[0-9])"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(sizes: Column) -> Column:
    """The sum of all earlier elements, for each; by blocks of about the root of the length."""
    def by_block(x: Column, b: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(x) / b).cast("int") - 1)), lambda i: F.slice(x, i * b + 1, b))
        total = lambda y: F.aggregate(y, F.lit(0), lambda a, v: a + v)
        return _let(blocks, lambda bs: _let(F.transform(bs, total), lambda sums: F.flatten(F.transform(
            bs, lambda y, i: _let(total(F.slice(sums, F.lit(1), i)), lambda before: F.transform(
                y, lambda v, j: before + total(F.slice(y, F.lit(1), j))))))))

    return _let(sizes, lambda x: _let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int")), lambda b: by_block(x, b)))


def _matches(text: Column, pattern: str, least: int = 0) -> Column:
    """All matches as structs (start, end, s, before, after), positions in code points."""
    def spans(found: Column, between: Column) -> Column:
        sizes = F.transform(found, lambda s, i: F.length(s) + F.length(F.get(between, i)))
        every = lambda at: F.transform(found, lambda s, i: F.struct(
            (F.get(at, i) + F.length(F.get(between, i))).cast("long").alias("start"),
            (F.get(at, i) + F.length(F.get(between, i)) + F.length(s)).cast("long").alias("end"),
            s.alias("s"), F.substring(F.get(between, i), -16, 16).alias("before"), F.substring(F.get(between, i + 1), 1, 4).alias("after"),
        ))
        return F.filter(_let(_running(sizes), every), lambda m: F.length(m["s"]) >= least)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: _let(F.split(text, pattern, -1), lambda between: spans(found, between)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _small_parts(s: Column) -> Column:
    """All dotted parts are at most 255."""
    short = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.forall(F.split(s, r"[^0-9]+"), lambda x: (F.length(short(x)) <= 3) & (F.coalesce(short(x).try_cast("int"), F.lit(0)) <= 255))


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda s: F.lit(True),
    "ip": _small_parts,
    "card": lambda s: F.length(_digits(s)).between(13, 19) & F.call_function("luhn_check", _digits(s)),
    "phone": lambda s: F.length(_digits(s)).between(9, 15),
}


def _can_hold(kind: str, text: Column) -> Column:
    """False only if neither pattern of the kind can match: most texts need no further look."""
    if kind == "email":
        return text.contains("@") | text.rlike(r"[\[(](?i:at)[\])]")
    return text.rlike({"ip": r"[0-9](?:\.|\[\.\]|,)[0-9]", "card": r"[0-9][\x20./-]?[0-9]", "phone": r"[0-9][\x20()./-]{0,3}[0-9]|\+[0-9]"}[kind])


def _shaped(kind: str, m: Column) -> Column:
    """A match is written like its kind, passes the kind's check and, if of digits, is no part of something longer."""
    s = m["s"]
    fits = s.rlike(SHAPES[kind])
    if kind == "email":
        return fits
    if kind == "phone":
        fits = fits & ~s.rlike(DATE)
    return fits & CHECKS[kind](s) & ~m["before"].rlike(JOINED_BEFORE) & ~m["after"].rlike(JOINED_AFTER)


def _evident(value: Callable[[str], Column]) -> Column:
    """The shape of its kind is enough, but a phone has no checksum and needs a word before."""
    return (value("shape") == 1) & ((value("kind_no") != KINDS.index("phone")) | (value("word_before") == 1))


def _masked() -> dict[str, Column]:
    """The features of a base span as they were if it were written in a form that the base patterns miss."""
    f = F.col
    cuts = F.when(f("groups") > 1, f("groups") - 1).otherwise(F.lit(3.0))  # of a card, by dots
    forms = {
        "email": {"n": f("n") + 3, "letters": f("letters") + 2, "marks": f("marks") + 1, "groups": f("groups") + 1, "brackets": f("brackets") + 2},
        "ip": {"n": f("n") + 6, "marks": f("marks") + 6},
        "card": {"n": f("digits") + cuts, "marks": cuts, "groups": cuts + 1, "spaces": F.lit(0.0), "dots": cuts},
        "phone": {"n": f("n") - 1, "marks": f("marks") - 1, "groups": f("groups") - 1, "plus": F.lit(0.0)},
    }
    out = {}
    for name in FEATURES:
        value = F.lit(1.0) if name == "shape" else f(name)
        for kind in KINDS:
            if name in forms[kind]:
                value = F.when(f("kind") == kind, forms[kind][name]).otherwise(value)
        out[name] = value
    return out


def _featured(kind: str, m: Column) -> Column:
    s, flag = m["s"], lambda c: c.cast("double")
    count = lambda pattern: F.length(F.regexp_replace(s, pattern, "")).cast("double")
    digits = count("[^0-9]")
    values = {
        "kind_no": F.lit(float(KINDS.index(kind))), "n": F.length(s).cast("double"), "digits": digits, "letters": count("[^A-Za-z]"),
        "marks": count(r"[A-Za-z0-9\s]"), "groups": F.size(F.split(s, "[^0-9A-Za-z]+")).cast("double"), "plus": flag(s.startswith("+")),
        "brackets": count("[^()]"), "spaces": count(r"[^\s]"), "dots": count("[^.]"),
        "checksum": flag((digits > 1) & F.call_function("luhn_check", _digits(s))) if kind == "card" else F.lit(0.0),
        "small_parts": flag(_small_parts(s)) if kind == "ip" else F.lit(0.0),
        "first_digit": F.coalesce(F.regexp_extract(s, "[0-9]", 0).try_cast("double"), F.lit(-1.0)),
        "before_letter": flag(m["before"].rlike(r"[\p{L}_=\x22]$")), "before_space": flag(m["before"].rlike(r"(?:^|\s)$")),
        "after_letter": flag(m["after"].rlike(r"^[\p{L}_=\x22]")), "after_space": flag(m["after"].rlike(r"^(?:\s|$)")),
        "after_digit": flag(m["after"].rlike(r"^.?[0-9]")), "word_before": flag(m["before"].rlike(WORDS[kind])),
        "shape": flag(_shaped(kind, m)),
    }
    return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), *[values[f].alias(f) for f in FEATURES])


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `_base` and `_maybe`: arrays of structs (kind, start, end, ...), base spans by kind and start."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))

    plain = "array<struct<kind:string,start:bigint,end:bigint>>"
    full = plain[:-2] + "," + ",".join(f"{f}:double" for f in FEATURES) + ">>"

    def base(kind: str) -> Column:
        good = F.filter(_matches(text, BASE[kind]), lambda m: CHECKS[kind](m["s"]))
        return F.transform(good, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    def maybe(kind: str) -> Column:
        return F.transform(_matches(text, CANDIDATES[kind], LEAST_LENGTH[kind]), partial(_featured, kind))

    def where(kind: str, found: Column, kind_of: str) -> Column:
        return F.when(_can_hold(kind, text), found).otherwise(F.array().cast(kind_of))

    return docs.select(
        "*", F.concat(*[where(k, base(k), plain) for k in KINDS]).alias("_base"), F.concat(*[where(k, maybe(k), full) for k in KINDS]).alias("_maybe"))


@dataclass(frozen=True)
class SpanModel:
    """Trees as (weight, nested tuples) and a threshold for each kind; without trees only candidates with evidence are added."""

    trees: tuple
    thresholds: dict[str, float]

    def probability(self, value: Callable[[str], Column]) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            feature, cut, left, right = node
            return F.when(value(FEATURES[feature]) <= cut, walk(left)).otherwise(walk(right))

        margin = sum((F.lit(w) * walk(t) for w, t in self.trees), F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def _tree(node):
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild()))


def fit_spans(found: DataFrame, train_rows: int = TRAIN_ROWS, rounds: int = ROUNDS, depth: int = DEPTH, precision: float = PRECISION, seed: int = 3) -> SpanModel:
    """Fit on at most `train_rows` examples from `with_candidates` rows, drawn by hash; thresholds come from all held-out ones."""
    use_shared_checkpoints(found.sparkSession)
    c = F.col("c")
    is_base = F.exists("_base", lambda b: (b["kind"] == c["kind"]) & (b["start"] == c["start"]) & (b["end"] == c["end"]))
    touches = F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    label = (
        F.when(is_base, 1.0).when(touches, None).when(_evident(lambda f: c[f]), 1.0)
        .when((c["shape"] == 0) & (c["word_before"] == 0), 0.0)
    )
    labelled = found.select("_base", F.explode("_maybe").alias("c")).select(label.alias("label"), is_base.alias("base"), "c.*").where("label IS NOT NULL")
    rows = materialise(
        labelled.select("label", "kind", "start", "end", *[F.when(F.col("base"), v).otherwise(F.col(f)).alias(f) for f, v in _masked().items()])
        .withColumn("draw", F.xxhash64(F.lit(seed), "kind", "start", "end", *FEATURES)),
        "candidates",
    )
    learn = rows.where("pmod(draw, 5) > 0").orderBy("draw").limit(train_rows)
    seen = {r.label: r.n for r in learn.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        return SpanModel((), {})
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(materialise(learn, "learn"))
    model: GBTClassificationModel = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed).fit(table.select("features", "label"))
    trees = tuple((float(w), _tree(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t.rootNode())) for w, t in zip(model.treeWeights, model.trees))
    fitted = SpanModel(trees, {})
    cell = F.floor(fitted.probability(F.col) * CELLS).cast("int")
    counts = rows.where("pmod(draw, 5) = 0").groupBy("kind", cell.alias("cell")).agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect()
    thresholds = {}
    for kind in KINDS:  # at most CELLS + 1 counts each
        good = n = 0.0
        for r in sorted((r for r in counts if r.kind == kind), key=lambda r: -r.cell):
            good, n = good + r.good, n + r.n
            if good >= precision * n:
                thresholds[kind] = r.cell / CELLS
    return SpanModel(trees, thresholds)


def with_spans(docs: DataFrame, text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """Adds `_base` and `_spans`: arrays of (kind, start, end), base spans first by kind and start, `_spans` with the added ones.

    Starts and ends are in code points, ends exclusive. A null text has none.
    """
    found = materialise(with_candidates(docs, text_col), "spans")
    model = model or fit_spans(found)
    limit = F.lit(2.0)

    def chosen(m: Column) -> Column:
        own = limit
        for kind, cut in model.thresholds.items():
            own = F.when(m["kind"] == kind, F.lit(cut)).otherwise(own)
        clear = ~F.exists("_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
        value = lambda f: m[f]
        likely = model.probability(value) >= own if model.trees and model.thresholds else F.lit(False)
        return (_evident(value) | likely) & clear

    def apart(es: Column) -> Column:
        """Of overlapping additions the first and longest stays; one that is dropped drops no other."""
        none = F.array().cast("array<struct<start:bigint,back:bigint,kind:string>>")
        return F.aggregate(es, none, lambda kept, m: F.when(
            (F.size(kept) > 0) & (-F.element_at(kept, -1)["back"] > m["start"]), kept).otherwise(F.concat(kept, F.array(m))))

    extra = F.sort_array(F.transform(F.filter("_maybe", chosen), lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("back"), m["kind"].alias("kind"))))
    added = F.transform(apart(extra), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), (-m["back"]).alias("end")))

    def by_kind(spans: Column) -> Column:
        of = lambda kind: F.filter(spans, lambda m: m["kind"] == kind)
        return F.concat(*[F.array_sort(of(k)) for k in KINDS])

    ordered = _let(F.concat("_base", added), by_kind)
    return found.withColumn("_spans", ordered).drop("_maybe")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row.

    The counts and base_sha256 are of the base spans, `spans` has all. A null
    or empty text has none. Rows that repeat give repeated rows; an empty table
    gives an empty one, without a model. n_added counts what the base patterns
    miss.
    """
    rows = with_spans(docs.select(quoted(id_col).alias(id_col), quoted(text_col).alias(text_col)), text_col)
    count = lambda k: F.size(F.filter("_base", lambda m: m["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select(
        quoted(id_col), *[count(k) for k in KINDS], F.sha2(_written(F.col("_base")), 256).alias("base_sha256"),
        _written(F.col("_spans")).alias("spans"), (F.size("_spans") - F.size("_base")).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    rows = with_spans(docs, text_col)
    ordered = F.array_sort(F.transform("_spans", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"))))
    joined = F.aggregate(
        ordered, F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"),
        lambda done, m: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] > m["start"]),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], m["end"]).alias("end"),
                F.element_at(done, -1)["kind"].alias("kind")))),
        ).otherwise(F.concat(done, F.array(m))),
    )
    text = quoted(text_col)

    def clean(spans: Column) -> Column:
        end = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"]).cast("int")
        pieces = F.transform(spans, lambda m, i: F.concat(
            text.substr(end(i) + 1, m["start"].cast("int") - end(i)), F.lit("["), F.upper(m["kind"]), F.lit("]")))
        last = end(F.size(spans))
        return F.concat(F.array_join(pieces, ""), text.substr(last + 1, F.length(text)))

    return rows.withColumn(text_col, F.when(F.size("_spans") > 0, _let(joined, clean)).otherwise(text)).select(*[quoted(c) for c in docs.columns])
