"""Repeated byte strings by the interval tree of a sparse enhanced suffix array.

Only suffixes at anchors are kept: positions whose hash of the next `ANCHOR`
bytes is the smallest of some window, so every string of `least` bytes holds an
anchor, the same ones wherever it occurs. Suffixes meet by anchor. Occurrences
with equal surroundings are one leaf with a count; the distinct surroundings of
an anchor are sorted as suffixes, and a stack scan of their common-prefix
lengths visits the interval tree. For each interval the left extensions are
tested: members that agree to the left as far as `least` asks are one repeat
group, with all its members and not only with neighbours. No group is returned:
the operator gives what the groups cover of each text. `repeat_groups` lists
those of the members of one anchor.

An anchor with more than `HOT_LEAVES` distinct surroundings is not scanned as one
row. Two members share a string of `least` bytes if they agree on some number
of bytes to the left and on the rest to the right. That number's range is cut
into parts; for each part, members meet by the bytes that all of the part asks
for, equal ones become one leaf again, and groups that are still too large are
cut further, down to a single number, where a group is one leaf.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import quoted
from ..plans.durable import materialise
from .common import arrow_of, renamed, ship
from .shingles import _BASE, _BYTE, _INVERSE, _powers_of, mixed
from .tokens import batch_of

LEAST = 200
CHUNK_BYTES = 2_000_000
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64_000_000
HOT_LEAVES = 4096
PARTS = 4
_PLAIN = _BYTE.copy()
_PLAIN[65:91] = _PLAIN[97:123] ^ np.uint64(0x5DEECE66D0000002)  # here capitals count


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best of x[i:i+w] for each i up to len(x) - w, by running bests within blocks."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, x[-1], dtype=x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, w)
    forward = best.accumulate(grid, axis=1).reshape(-1)
    backward = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return best(backward[: n - w + 1], forward[w - 1 : n])


def anchors(texts: list[bytes], least: int = LEAST):
    """(text number, position, anchor hash, hash of the surroundings) of every anchor."""
    k = least // 2
    w = least - k + 1
    cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(data)
    if n < least:
        return (np.zeros(0, dtype=np.int64),) * 4
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_PLAIN[data] * _powers_of("up", _BASE, n))])
    down = _powers_of("down", _INVERSE, n)
    grams = mixed((total[k:] - total[: n - k + 1]) * down[: n - k + 1]) | np.uint64(1)
    lowest = _sliding(grams, w, np.minimum)
    room = np.zeros(n + 1, dtype=np.int64)  # windows that leave their text do not count
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a >= least:
            room[a] += 1
            room[b - least + 1] -= 1
    lowest[np.cumsum(room)[: len(lowest)] == 0] = 0
    zeros = np.zeros(w - 1, dtype=np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([zeros, lowest, zeros]), w, np.maximum)[: len(grams)] == grams)
    text = np.searchsorted(cuts, at, side="right") - 1
    left, right = np.maximum(at - (least - k), cuts[text]), np.minimum(at + least, cuts[text + 1])
    around = mixed((total[right] - total[left]) * down[left] + (at - left).astype(np.uint64) * np.uint64(512) + (right - at).astype(np.uint64))
    return text, at - cuts[text], grams[at].view(np.int64), around.view(np.int64)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix: the highest bit in which the two differ, as big numbers."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def intervals(members: list[tuple[bytes, bytes]]):
    """The common-prefix intervals of distinct surroundings of one anchor, deepest first.

    A member is (bytes before the anchor reversed, bytes from the anchor on).
    An interval is (its members in the order of their left sides, the common
    lengths of neighbours there, its common right length). Of members with the
    same left side only one goes on to wider intervals: it stands for them.
    """
    order = sorted(range(len(members)), key=lambda i: members[i][1])
    shared = [_common(members[a][1], members[b][1]) for a, b in zip(order, order[1:])]
    stack: list[tuple[int, list[int]]] = []  # (common right length, members that still count)
    for i, member in enumerate(order):
        here, depth = [member], shared[i] if i < len(shared) else -1
        while stack and stack[-1][0] > depth:
            length, inside = stack.pop()
            by_left = sorted(inside + here, key=lambda m: members[m][0])
            yield by_left, [_common(members[a][0], members[b][0]) for a, b in zip(by_left, by_left[1:])], length
            here = [m for m, before in zip(by_left, [None, *by_left]) if before is None or members[m][0] != members[before][0]]
        if stack and stack[-1][0] == depth:
            stack[-1][1].extend(here)
        else:
            stack.append((depth, here))


def repeat_groups(members: list[tuple[bytes, bytes]], least: int = LEAST) -> list[tuple[list[int], int, int]]:
    """Repeat groups with all their members: (members, bytes to the left, bytes to the right).

    Each interval gives, for its common right length, the groups of members
    whose left sides agree to at least `least` bytes in all; where some agree
    farther left, they are a group of their own too.
    """
    found = []
    for by_left, same, length in intervals(members):
        stack: list[tuple[int, int]] = []
        for i, depth in enumerate([*same, -1]):
            first = i
            while stack and stack[-1][1] > depth:
                first, at = stack.pop()
                if at + length >= least:
                    found.append((by_left[first : i + 1], at, length))
            if not stack or stack[-1][1] < depth:
                stack.append((first, depth))
    return found


def spans_of(members: list[tuple[bytes, bytes]], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(member, bytes to the left, bytes to the right): what the groups of `repeat_groups` cover of each member.

    In an interval a member's deepest group reaches as far left as its nearer
    neighbour; a wider interval, shorter to the right, counts only if it
    reaches farther left.
    """
    best, out = [-1] * len(members), []
    for by_left, same, length in intervals(members):
        for m, before, after in zip(by_left, [-1, *same], [*same, -1]):
            left = max(before, after)
            if left > best[m] and left + length >= least:
                best[m] = left
                out.append((m, left, length))
    return out


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ends, starts))
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(ends) - 1]])]


def _parts(members: DataFrame, least: int) -> DataFrame:
    """Each member once for each part of its range low..high of bytes to the left that it is long enough for.

    `grp` is of the bytes that the whole part asks for, `leaf` of all that the part can use.
    """
    ddl = "grp long, leaf binary, n long, rk long, pos int, low int, high int, before binary, after binary"
    out = arrow_of(ddl)

    def run(batches):
        for batch in batches:
            cols = {f.name: [] for f in out}
            for grp, n, rk, pos, low, high, before, after in zip(*(batch.column(i).to_pylist() for i in range(8))):
                step = -(-(high - low + 1) // PARTS)
                for a in range(low, high + 1, step):
                    b = min(high, a + step - 1)
                    left, right = before[:b], after[: least - a]
                    if len(before) < a or len(after) < least - b or len(left) + len(right) < least:
                        continue
                    asked = hashlib.blake2b(b"%d %d|" % (grp, a) + before[:a] + after[: least - b], digest_size=8)
                    every = hashlib.blake2b(b"%d %d %d|" % (grp, a, len(left)) + left + right, digest_size=16)
                    values = (int.from_bytes(asked.digest(), signed=True), every.digest(), n, rk, pos, a, b, left, right)
                    for name, value in zip(cols, values):
                        cols[name].append(value)
            yield batch_of(out, **cols)

    return members.select("grp", "n", "rk", "pos", "low", "high", "before", "after").mapInArrow(run, ddl)


def _settled(members: DataFrame, hot: DataFrame, least: int, hot_leaves: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(spans of equal members, packed groups of at most `hot_leaves` members).

    members: (grp, n, rk, pos, low, high, before, after), n > 1 if covered
    already; hot: the grp with more members than `hot_leaves`.
    """
    spans, packs = [], []

    def pick(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
        return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)

    while True:
        hot = materialise(hot, "hot-groups")
        none = hot.isEmpty()
        members = members if none else materialise(members, "members")
        cold = members if none else pick(members, hot, ["grp"], "left_anti")
        packs.append(
            cold.groupBy("grp").agg(*[F.collect_list(c).alias(c) for c in ("n", "rk", "pos", "before", "after")])
            .where(F.size("rk") > 1).drop("grp"))
        if none:
            return spans, packs
        parts = materialise(_parts(pick(members, hot, ["grp"], "left_semi"), least), "parts")
        leaves = materialise(parts.groupBy("grp", "leaf").agg(
            F.count(F.lit(1)).alias("size"), F.min(F.struct("n", "rk", "pos", "low", "high", "before", "after")).alias("one")), "part-leaves")
        # large leaves are few and do not meet their members in one task
        key, own = ["grp", "leaf"], parts.where("n = 1")
        large = materialise(leaves.where(F.col("size") > hot_leaves).select(key), "large-leaves")
        equal = pick(own, large, key, "left_semi").unionByName(
            pick(own, large, key, "left_anti").join(leaves.where((F.col("size") > 1) & (F.col("size") <= hot_leaves)).select(key), key, "left_semi"))
        spans.append(equal.select("rk", (F.col("pos") - F.length("before")).alias("first"), (F.col("pos") + F.length("after")).alias("last")))
        n = F.when(F.col("size") > 1, F.lit(2)).otherwise(F.col("one.n")).cast("long").alias("n")
        members = leaves.select("grp", n, *[F.col(f"one.{c}").alias(c) for c in ("rk", "pos", "low", "high", "before", "after")])
        hot = leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("leaves")).where(F.col("leaves") > hot_leaves).select("grp")


def repeated_spans(rows: DataFrame, least: int = LEAST, hot_leaves: int = HOT_LEAVES) -> DataFrame:
    """(rk, starts, ends): the merged byte ranges of each text that repeats cover. rows: (rk, text), rk unique to a text and id."""
    ddl = "akey long, around long, rk long, pos int"
    out = arrow_of(ddl)
    k = least // 2

    def find(batches):
        for batch in batches:
            keys, part, first, size = np.asarray(batch.column(0)), [], 0, 0
            texts = batch.column(1).to_pylist()
            for i, t in enumerate(texts):
                part.append(t.encode())
                size += len(part[-1])
                if size >= CHUNK_BYTES or i == len(texts) - 1:
                    text, pos, akey, around = anchors(part, least)
                    yield batch_of(out, akey=akey, around=around, rk=keys[first:][text], pos=pos)
                    part, first, size = [], i + 1, 0

    every = materialise(rows.mapInArrow(find, ddl), "anchors")
    shared = materialise(every.groupBy("akey").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("akey"), "shared-anchors")
    met = materialise(every.join(shared, "akey"), "met-anchors")
    leaves = materialise(met.groupBy("akey", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rk", "pos")).alias("one")), "leaves")
    whole = met.join(leaves.where("n > 1").select("akey", "around"), ["akey", "around"]).select("rk", F.col("pos").alias("first"), F.col("pos").alias("last"))
    mixed_keys = materialise(
        leaves.groupBy("akey").agg(F.count(F.lit(1)).alias("leaves"), F.min("n").alias("fewest")).where("leaves > 1 AND fewest = 1").drop("fewest"), "mixed-anchors")
    hot = mixed_keys.where(F.col("leaves") > hot_leaves).select(F.col("akey").alias("grp"))
    wanted = materialise(leaves.join(mixed_keys.select("akey"), "akey").select("akey", "n", "one.rk", "one.pos"), "wanted")

    needed = materialise(wanted.groupBy("rk").agg(F.collect_list(F.struct("akey", "n", "pos")).alias("at")), "wanted-texts")
    small = needed.select("rk").count() <= BROADCAST_ROWS
    ids = needed.select("rk")
    texts = rows.join(F.broadcast(ids) if small else ids, "rk", "left_semi").dropDuplicates(["rk"])
    ddl2 = "akey long, n long, rk long, pos int, before binary, after binary"
    out2 = arrow_of(ddl2)

    def cut(batches):
        for batch in batches:
            for rk, text, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = text.encode()
                pos = [x["pos"] for x in at]
                yield batch_of(
                    out2, akey=[x["akey"] for x in at], n=[x["n"] for x in at], rk=[rk] * len(at), pos=pos,
                    before=[raw[max(0, p - least + k) : p][::-1] for p in pos], after=[raw[p : p + least] for p in pos],
                )

    around = texts.join(needed, "rk").select("rk", "text", "at").mapInArrow(cut, ddl2)
    ranged = around.select(F.col("akey").alias("grp"), "n", "rk", "pos", F.lit(0).alias("low"), F.lit(least - k).alias("high"), "before", "after")
    equal, packs = _settled(ranged, hot, least, hot_leaves)
    ddl3 = "rk long, first int, last int"
    out3 = arrow_of(ddl3)

    def scan(batches):
        for batch in batches:
            rk, first, last = [], [], []
            for n, rks, pos, before, after in zip(*(batch.column(i).to_pylist() for i in range(5))):
                for m, left, right in spans_of(list(zip(before, after)), least):
                    if n[m] == 1:  # the others are covered as whole leaves
                        rk.append(rks[m])
                        first.append(pos[m] - left)
                        last.append(pos[m] + right)
            yield batch_of(out3, rk=rk, first=first, last=last)

    # a whole leaf covers its surroundings; what lies beyond the ends of the text is cut off below
    leaf_spans = whole.select("rk", (F.col("first") - F.lit(least - k)).alias("first"), (F.col("last") + F.lit(least)).alias("last"))
    spans = leaf_spans
    for more in [*equal, *[p.mapInArrow(scan, ddl3) for p in packs]]:
        spans = spans.unionByName(more)
    ddl4 = "rk long, starts array<int>, ends array<int>"
    out4 = arrow_of(ddl4)

    def merge(batches):
        for batch in batches:
            starts, ends = [], []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                s, e = _merged(np.array(a), np.array(b))
                starts.append(np.maximum(s, 0).astype(np.int32))
                ends.append(e.astype(np.int32))
            yield batch_of(out4, rk=batch.column(0), starts=starts, ends=ends)

    return spans.groupBy("rk").agg(F.collect_list("first").alias("a"), F.collect_list("last").alias("b")).mapInArrow(merge, ddl4)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, with_text: bool = False,
                   hot_leaves: int = HOT_LEAVES) -> DataFrame:
    """One row per input row: (id, n_bytes, n_removed, n_spans, kept_sha256), and with `with_text` kept, the bytes left.

    Every byte covered by a string of `least` bytes that also starts elsewhere,
    in any text or the same, is removed; texts are UTF-8, null counts as empty,
    and shorter texts lose nothing. Rows that repeat count as texts of their
    own, so both lose what they share. An empty table gives an empty one.
    """
    ship(docs.sparkSession)
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rk"))
    spans = materialise(repeated_spans(keyed.select("rk", "text"), least, hot_leaves), "repeat-spans")
    small = (spans.agg(F.sum(F.lit(48) + 8 * F.size("starts"))).first()[0] or 0) <= BROADCAST_BYTES
    both = keyed.join(F.broadcast(spans) if small else spans, "rk", "left").select("doc_id", "text", "starts", "ends")
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    out = arrow_of(ddl)

    def run(batches):
        for batch in batches:
            cols = {f.name: [] for f in out}
            for doc, text, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw = text.encode()
                at, kept = 0, []
                for a, b in zip(starts or [], ends or []):
                    kept.append(raw[at:a])
                    at = min(b, len(raw))
                rest = b"".join([*kept, raw[at:]])
                values = {"doc_id": doc, "n_bytes": len(raw), "n_removed": len(raw) - len(rest), "n_spans": len(starts or []),
                          "kept_sha256": hashlib.sha256(rest).hexdigest(), "kept": rest}
                for name in cols:
                    cols[name].append(values[name])
            yield batch_of(out, **cols)

    return renamed(both.mapInArrow(run, ddl), id_col)
