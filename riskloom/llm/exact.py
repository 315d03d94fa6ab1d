"""Exact duplicates with heavy hitters split off, in DataFrame functions only.

Misra-Gries counters (Spark's `freqItems`) name the digests that may hold more
than a `support` share of the rows: at most 1 / support of them. Their exact
counts are taken, and the verified winners, a table of bounded size, are
broadcast: their rows are answered where they lie. All other digests are
shuffled; none of those has more than its share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import quoted
from ..plans.durable import materialise
from .common import renamed

SUPPORT = 0.0005
#: Ids of dropped rows are broadcast up to this number, else their join is shuffled.
BROADCAST_ROWS = 500_000

#: Runs of white space that are not already one space.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _RUNS, " ")


def text_digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when they are after `normalised`; of equal texts the row
    with the smallest id stays, a null id coming last and of rows that repeat
    an id exactly one. Null and empty texts are equal to one another. An empty
    table gives an empty one.
    """
    rows = materialise(
        docs.select(
            quoted(id_col).alias("doc_id"), text_digest(quoted(text_col)).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    size = F.count(F.lit(1))
    total = rows.count()
    maybe = rows.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    winners = materialise(
        rows.join(F.broadcast(maybe), "text_sha256").groupBy("text_sha256").agg(first.alias("first"), size.alias("group_size"))
        .where(F.col("group_size") > max(1.0, support * total)),
        "heavy",
    )
    hot = rows.join(F.broadcast(winners), "text_sha256")  # at most 1 / support winners
    group = Window.partitionBy("text_sha256")
    cold = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti").select(
        "*", first.over(group).alias("first"), size.over(group).alias("group_size")
    )
    answer = [
        F.col("doc_id"), F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256",
    ]
    return renamed(hot.select(*answer).unionByName(cold.select(*answer)), id_col)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows that `exact_groups` keeps, with all their columns."""
    groups = materialise(exact_groups(docs, id_col, text_col, support).select(F.col(id_col).alias("_keep"), "kept", "text_sha256"), "exact")
    kept = groups.where("kept")
    repeats = groups.groupBy("_keep").count().where("count > 1 OR _keep IS NULL").limit(1).count()
    if not repeats:
        dropped = groups.where("NOT kept").select("_keep")  # far fewer rows than stay, so whole texts need no shuffle
        small = dropped.count() <= BROADCAST_ROWS
        return docs.join(F.broadcast(dropped) if small else dropped, quoted(id_col) == F.col("_keep"), "left_anti")
    # ids that repeat: the digest tells their texts apart, and of wholly equal keys one row stays
    keyed = docs.withColumn("_digest", text_digest(quoted(text_col)))
    same = quoted(id_col).eqNullSafe(F.col("_keep")) & (F.col("_digest") == F.col("text_sha256"))
    return keyed.join(kept, same, "left_semi").dropDuplicates([id_col, "_digest"]).drop("_digest")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
