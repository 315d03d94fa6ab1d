"""Token ids as files of interleaved range-ANS blocks.

Documents go in ascending id order to partitions of blocks. All blocks share
one static frequency table, counted over every id. A block holds whole
documents and decodes without any other: it is coded by `lanes` interleaved
states, keeps the states and the word position every `CHECK_STEPS` steps as
checkpoints, so that its parts can also be decoded in parallel, and carries the
crc32 of each part's ids, which decoding verifies.

The file format is a parquet table of blocks (written and committed by Spark,
so a lost executor leaves no half file) and one of (id, frequency) pairs.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.durable import fresh_path
from .common import arrow_of, renamed, text_rows
from .tokens import batch_of, id_array, text_encoder

BLOCK_IDS = 1 << 20
LANES = 2048
CHECK_STEPS = 256
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
WORD_MASK = np.uint64(0xFFFFFFFF)

DOCS = "doc_ids array<long>, doc_lengths array<long>"
PLAIN = f"part int, block int, local_start long, n_ids long, {DOCS}, ids binary"
CODED = (
    f"part int, block int, start long, n_ids long, {DOCS}, lanes int, check_steps int, "
    "states binary, positions array<long>, checksums array<long>, words binary"
)


@dataclass(frozen=True)
class Table:
    """Static frequencies that sum to 2 ** bits; an id that never occurs has frequency 0."""

    bits: int
    freq: np.ndarray
    below: np.ndarray
    symbol: np.ndarray

    @staticmethod
    def of(freq: np.ndarray, bits: int) -> Table:
        below = np.concatenate([[0], np.cumsum(freq)[:-1]])
        return Table(bits, freq.astype(np.uint64), below.astype(np.uint64), np.repeat(np.arange(len(freq), dtype=np.uint32), freq))


def scaled(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies of about the counts' shares, at least 1 for every id that occurs, and the bits of their sum."""
    used = int((counts > 0).sum())
    bits = max(12, min(24, used.bit_length() + 3))
    size = 1 << bits
    if not used:
        counts, used = np.ones(1, dtype=np.int64), 1
    freq = np.where(counts > 0, np.maximum(1, (counts * (float(size) / counts.sum())).astype(np.int64)), 0)
    spare = size - int(freq.sum())
    for i in np.argsort(-freq, kind="stable"):  # the largest take up the rounding
        step = max(spare, 1 - int(freq[i]))
        freq[i] += step
        spare -= step
        if not spare:
            break
    return freq, bits


def encode_block(ids: np.ndarray, t: Table, lanes: int = LANES, check_steps: int = CHECK_STEPS):
    """(lanes, states of each part, word positions, crc32 of each part's ids, words)."""
    lanes = max(1, min(lanes, len(ids) // 64))
    steps = -(-len(ids) // lanes)
    full = np.full(steps * lanes, ids[0] if len(ids) else 0, dtype=np.int64)
    full[: len(ids)] = ids
    freq, below = t.freq[full].reshape(steps, lanes), t.below[full].reshape(steps, lanes)
    bits, shift = np.uint64(t.bits), np.uint64(63 - t.bits)
    out, states, sizes = [], [], []
    for first in range(0, steps, check_steps):
        x, words = np.full(lanes, LOW, dtype=np.uint64), []
        for s in range(min(first + check_steps, steps) - 1, first - 1, -1):
            f = freq[s]
            over = x >= f << shift
            words.append((x[over] & WORD_MASK).astype("<u4"))
            x = np.where(over, x >> WORD, x)
            q = x // f
            x = (q << bits) + (x - q * f) + below[s]
        states.append(x)
        out += words[::-1]
        sizes.append(sum(map(len, words)))
    raw = ids.astype("<u4")
    sums = [zlib.crc32(raw[a : a + lanes * check_steps]) for a in range(0, len(raw), lanes * check_steps)]
    positions = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int).tolist() if sizes else []
    return lanes, np.array(states, dtype="<u8").tobytes(), positions, sums, b"".join(w.tobytes() for w in out)


def decode_part(part: int, n_ids: int, lanes: int, check_steps: int, states: bytes, positions: list[int], checksums: list[int], words: bytes, t: Table) -> np.ndarray:
    """The ids of one part of a block, from its checkpoint on; raises if their crc32 differs."""
    first = part * lanes * check_steps
    n = min(n_ids - first, lanes * check_steps)
    steps = -(-n // lanes)
    x = np.frombuffer(states, dtype="<u8", count=lanes, offset=8 * lanes * part).astype(np.uint64)
    stream, at = np.frombuffer(words, dtype="<u4"), positions[part]
    out = np.empty((steps, lanes), dtype="<u4")
    bits, mask = np.uint64(t.bits), np.uint64((1 << t.bits) - 1)
    for s in range(steps):
        slot = x & mask
        found = t.symbol[slot]
        out[s] = found
        x = t.freq[found] * (x >> bits) + slot - t.below[found]
        low = np.flatnonzero(x < LOW)
        x[low] = x[low] << WORD | stream[at : at + len(low)]
        at += len(low)
    ids = out.reshape(-1)[:n]
    if zlib.crc32(ids) != checksums[part]:
        raise ValueError(f"checksum of part {part} differs")
    return ids


def plain_blocks(docs: DataFrame, path: str, end_id: int | None, block_ids: int, id_col: str, text_col: str) -> DataFrame:
    """Blocks of whole documents in ascending id order within range partitions; null ids come first."""
    ordered = text_rows(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    out = arrow_of(PLAIN.removeprefix("part int, "))
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        coder = text_encoder(path)
        width = "<u2" if max(coder.n_ids, (end_id or 0) + 1) <= 1 << 16 else "<u4"
        block, start, held, names, sizes, n = 0, 0, [], [], [], 0

        def row():
            return batch_of(out, block=[block], local_start=[start], n_ids=[n], doc_ids=[names], doc_lengths=[sizes], ids=[b"".join(held)])

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), coder(batch.column(1).to_pylist())):
                raw += end
                held.append(id_array(raw).astype(width).tobytes())
                names.append(doc)
                sizes.append(len(raw) // 4)
                n += sizes[-1]
                if n >= block_ids:
                    yield row()
                    block, start, held, names, sizes, n = block + 1, start + n, [], [], [], 0
        if names:
            yield row()

    blocks = ordered.mapInArrow(run, PLAIN.removeprefix("part int, "))
    return blocks.select(F.spark_partition_id().alias("part"), "*")


def width_of(n_ids: int, raw: bytes) -> str:
    return "<u4" if n_ids and len(raw) == 4 * n_ids else "<u2"


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int | None = None, block_ids: int = BLOCK_IDS,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write all ids, documents in ascending id order, below `folder`.

    A null or empty text has no ids but the end id. An empty table writes an
    empty one. Rows that repeat an id follow one another in any order.
    """
    spark = docs.sparkSession
    plain = fresh_path(spark, "ids")
    plain_blocks(docs, path, end_id, block_ids, id_col, text_col).write.option("compression", "zstd").parquet(plain)
    blocks = spark.read.schema(PLAIN).parquet(plain)

    def count(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.bincount(np.frombuffer(raw, dtype=width_of(n, raw)))
                if len(found) > len(total):
                    total, found = found, total
                total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield batch_of(counted, id=ids, n=total[ids])

    counted = arrow_of("id long, n long")
    # one row per id of the vocabulary
    counts = blocks.select("n_ids", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, dtype=np.int64)
    flat[counts["id"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.int64)
    freq, bits = scaled(flat)
    spark.createDataFrame(
        pa.table({"id": np.flatnonzero(freq), "frequency": freq[freq > 0]}), "id long, frequency long"
    ).coalesce(1).write.parquet(f"{folder}/frequencies")
    shared = spark.sparkContext.broadcast(freq)

    before, starts = 0, {}
    for part, n in sorted(blocks.groupBy("part").agg(F.sum("n_ids")).collect()):  # one row per written partition
        starts[part] = before
        before += n
    coded = arrow_of(CODED)

    def encode(batches):
        t = Table.of(shared.value, bits)
        for batch in batches:
            for r in range(batch.num_rows):
                part, block, start, n, names, sizes, raw = (batch.column(i)[r].as_py() for i in range(7))
                lanes, states, positions, sums, words = encode_block(np.frombuffer(raw, dtype=width_of(n, raw)), t)
                yield batch_of(
                    coded, part=[part], block=[block], start=[starts[part] + start], n_ids=[n], doc_ids=[names], doc_lengths=[sizes],
                    lanes=[lanes], check_steps=[CHECK_STEPS], states=[states], positions=[positions], checksums=[sums], words=[words],
                )

    blocks.mapInArrow(encode, CODED).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str, id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """Every document from the files: (id, start, n_tokens, ids), or ids_crc32 instead of ids with `digest`.

    start counts the ids of all documents before it; the crc32 is that of the
    ids as little-endian unsigned 32-bit integers.
    """
    table = spark.read.schema("id long, frequency long").parquet(f"{folder}/frequencies").toPandas()
    freq = np.zeros(int(table["id"].max()) + 1, dtype=np.int64)
    freq[table["id"].to_numpy()] = table["frequency"].to_numpy()
    bits = int(freq.sum()).bit_length() - 1
    shared = spark.sparkContext.broadcast(freq)
    ddl = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>")
    out = arrow_of(ddl)

    def decode(batches):
        t = Table.of(shared.value, bits)
        for batch in batches:
            for r in range(batch.num_rows):
                start, n, names, sizes, lanes, steps, states, positions, sums, words = (batch.column(i)[r].as_py() for i in range(10))
                parts = [decode_part(p, n, lanes, steps, states, positions, sums, words, t) for p in range(len(positions))]
                ids = np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
                cuts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                each = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                last = {"ids_crc32": [zlib.crc32(e) for e in each]} if digest else {"ids": [e.astype(np.int32) for e in each]}
                yield batch_of(out, doc_id=names, start=cuts[:-1] + start, n_tokens=sizes, **last)

    blocks = spark.read.schema(CODED).parquet(f"{folder}/blocks")
    return renamed(blocks.drop("part", "block").mapInArrow(decode, ddl), id_col)
