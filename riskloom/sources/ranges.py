"""CSV with line breaks inside quotes, read in byte ranges.

A reader that looks for record ends from the start of a file makes each file
one task. Here a file is read as lines, in as many ranges as Spark cuts it into.
A line break is inside quotes if the number of quotes before it is odd, so the
parity of each range's quotes, and a prefix sum over the ranges of a file, tell
how each range begins. Then every range finds its records by itself, and only
those that cross from one range into the next are shuffled and put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.durable import materialise
from ..plans.shipping import ship
from ..plans.small import pin_small

PIECES = "file string, block long, seq long, text string, before boolean, after boolean, header boolean"
_SCHEMA = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("text", pa.string()),
    ("before", pa.bool_()), ("after", pa.bool_()), ("header", pa.bool_()),
])
BLANK = ("", "\r")


class _Range:
    """The records of one range, as its lines come in."""

    def __init__(self, file: str, block: int, open_: int):
        self.file, self.block = file, block
        self.open = self.before = open_
        self.lines: list[str] = []
        self.seq = 0
        self.header = block == 0

    def take(self, values: pa.Array, odd: np.ndarray) -> Iterator[pa.RecordBatch]:
        after = (self.open + np.cumsum(odd)) & 1
        ends = np.flatnonzero(after == 0)
        self.open = int(after[-1])
        done = 0
        if len(ends) and (self.lines or self.before):  # the record that was open when these lines came
            done = int(ends[0]) + 1
            self.lines += values[:done].to_pylist()
            yield from self._emit(["\n".join(self.lines)], bool(self.before), False)
            self.lines, self.before, ends = [], 0, ends[1:]
        if len(ends):
            starts = np.concatenate([[done], ends[:-1] + 1])
            texts = values.take(pa.array(ends))
            longer = np.flatnonzero(starts < ends)
            if len(longer) or self.header:
                texts = texts.to_pylist()
                for i in longer:
                    texts[i] = "\n".join(values[starts[i] : ends[i] + 1].to_pylist())
            yield from self._emit(texts, False, False)
            done = int(ends[-1]) + 1
        self.lines += values[done:].to_pylist()

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.lines:
            yield from self._emit(["\n".join(self.lines)], bool(self.before), True)

    def _emit(self, texts: list[str] | pa.Array, before: bool, after: bool) -> Iterator[pa.RecordBatch]:
        n = len(texts)
        header = np.zeros(n, dtype=bool)
        if self.header:
            at = next((i for i, t in enumerate(texts) if t not in BLANK), None)
            if at is not None:
                header[at], self.header = True, False
        columns = [
            pa.repeat(pa.scalar(self.file), n), pa.repeat(pa.scalar(self.block, pa.int64()), n), pa.array(np.arange(self.seq, self.seq + n)),
            pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()),
            pa.repeat(pa.scalar(before), n), pa.repeat(pa.scalar(after), n), pa.array(header),
        ]
        self.seq += n
        yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def _records_of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in file order (file, block, value, odd, start) to records and the pieces of records at the edges of ranges."""
    now = None
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        file, block, value = batch.column("file"), batch.column("block").to_numpy(zero_copy_only=False), batch.column("value")
        odd = batch.column("odd").to_numpy(zero_copy_only=False).astype(np.int64)
        names = file.dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n]):
            name, at = file[a].as_py(), int(block[a])
            if now is None or (now.file, now.block) != (name, at):
                if now is not None:
                    yield from now.finish()
                now = _Range(name, at, batch.column("start")[a].as_py())
            yield from now.take(value.slice(a, b - a), odd[a:b])
    if now is not None:
        yield from now.finish()


def _whole(text: Column) -> Column:
    return F.regexp_replace(text, "\r\\z", "")


def split_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, header): the records of CSV files, one row each, those of blank lines left out.

    Lines end with a line feed, before which a carriage return may stand;
    breaks inside quotes stay as they are. Quotes must be balanced, as in text
    that follows RFC 4180: a quote in the middle of an unquoted value counts.
    `header` marks the first record of a file, looked for in its first range. A
    quote that is never closed makes one record of the rest of its file. The
    text is read twice and written once; only pieces at the edges of ranges
    are shuffled. Compressed files are one range each.
    """
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
        ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).cast("byte").alias("odd"),
        F.monotonically_increasing_id().alias("at"),  # rises within a range, which one task reads from its start
    )
    ranges = materialise(lines.groupBy("file", "block").agg((F.sum("odd") % 2).alias("odd")), "ranges")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = ranges.select("file", "block", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).cast("byte").alias("start")).where("start = 1")
    small = pin_small(opened)
    known = lines.join(small, ["file", "block"], "left").withColumn("start", F.coalesce("start", F.lit(0).cast("byte")))
    if small is opened:  # more open ranges than a broadcast may hold: the join is shuffled, so lines are put in order again
        known = known.repartition("file", "block").sortWithinPartitions("file", "block", "at")
    pieces = materialise(known.select("file", "block", "value", "odd", "start").mapInArrow(_records_of_ranges, PIECES), "records")
    edge = F.col("before") | F.col("after")
    in_order = Window.partitionBy("file").orderBy("block", "seq")
    parts = pieces.where(edge).withColumn("record", F.sum((~F.col("before")).cast("long")).over(in_order))
    joined = parts.groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "seq", "text"))).alias("parts"), F.max("header").alias("header")
    ).select("file", F.array_join(F.col("parts.text"), "\n").alias("text"), "header")
    both = pieces.where(~edge).select("file", "text", "header").unionByName(joined)
    return both.select("file", _whole(F.col("text")).alias("text"), "header").where("text <> ''")


def read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV as text columns, with line breaks inside quotes, in as many tasks as the files have ranges."""
    names = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).columns
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = split_records(spark, path).where("NOT header")
    parsed = rows.select(F.from_csv("text", schema, {"escape": '"', "multiLine": "true"}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(names)])
