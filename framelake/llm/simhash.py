"""SimHash near-duplicates with a Gray-order hierarchical index over ranges of fingerprints.

The distinct fingerprints are sorted by their rank in Gray order, in which
neighbours share long runs of bits, and cut into ``RANGES`` ranges, or more of
about ``RANGE`` entries. The index is one tree: upper nodes over the ranges, and below each range
nodes down to its entries. A node holds the bits on which all below it agree,
without those that a node above it holds already (shared masked patterns are
factored out upwards). A search adds up the differences from the root down and
leaves a whole group as soon as they exceed ``distance``.

Every task has the upper nodes (a few dozen bytes for each range) and routes
fingerprints through them to the ranges that may hold a link; only those at or
after a fingerprint's own range, since links are symmetric. In a range the
entries come first and form its part of the tree; visitors are streamed through it.

Exact copies share a fingerprint and are one entry. A task sends on a spanning
forest of a range's own links and one edge for each component that a visitor
meets.

Defined results: a null or empty text has fingerprint zero and is linked like
any other. Rows with a null id get the smallest id of their component like
others (null if all are null). Repeated rows give repeated rows; an empty table
an empty result. Fingerprints, upper nodes and components are made while the plan
is made.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, partitions_for, written
from .components import components
from .pretoken import gather

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are counted at once; nodes below a node; searches and frontier entries at once.
SHINGLES, FANOUT, SEARCHES, ROWS = 100_000, 4, 4096, 400_000
#: Ranges at least, so that a fingerprint's visits are alike at every size up to RANGES * RANGE entries, and entries of a range beyond.
RANGES, RANGE = 256, 65_536
#: Leading bits of a Gray rank by which entries are counted to cut ranges (a slot is never cut).
SLOT_BITS = 16
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, size: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each run of ``size`` words (of the whole sequence if it is shorter; none without words)."""
    words = text.encode("utf-8", "replace").translate(LOWER).split() if text else []
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    last = (ends - 1)[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip([0, *ends.tolist()], last)]


def fingerprints(texts: list[str | None], size: int = 3) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is set in over half the hashes."""
    return fingerprints_of(shingle_hashes(t, size) for t in texts)


def fingerprints_of(lists: Iterable[list[int]]) -> np.ndarray:
    """The fingerprints of some lists of shingle hashes."""
    out: list[np.ndarray] = []
    held: list[list[int]] = []
    count = 0

    def flush() -> None:
        n = np.array([len(h) for h in held], dtype=np.int64)
        made = np.zeros(len(held), dtype=np.uint64)
        some = np.flatnonzero(n)
        if len(some):
            flat = np.fromiter(chain.from_iterable(held), dtype="<u8", count=int(n.sum()))
            at = (np.cumsum(n) - n)[some]
            total = np.zeros((len(some), 64), dtype=np.int64)
            for a in range(0, len(flat), SHINGLES):  # a long text is counted in parts
                part = flat[a : a + SHINGLES]
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                x, y = np.searchsorted(at, [a, a + len(part)])
                first = x - 1 if x == len(at) or at[x] != a else x
                total[first:y] += np.add.reduceat(bits, np.concatenate([[0], at[first + 1 : y] - a]), axis=0, dtype=np.int64)
            high = (2 * total > n[some, None]).astype(np.uint8)
            made[some] = np.packbits(high, axis=1, bitorder="little").view("<u8").ravel()
        out.append(made)

    for hashes in lists:
        held.append(hashes)
        count += len(hashes)
        if count >= SHINGLES:
            flush()
            held, count = [], 0
    flush()
    return np.concatenate(out)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(shift))
    return codes


class GrayTree:
    """A tree over items in Gray order. An item is a fingerprint, or a group of them given by the AND and the OR of its fingerprints."""

    def __init__(self, both: np.ndarray, either: np.ndarray | None = None, fanout: int = FANOUT):
        self.n, self.visited, self.pruned, self.groups = len(both), 0, 0, either is not None  # nodes looked at and groups left, of all searches
        either = both if either is None else either
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # from the items up: first child, children, mask, pattern
        if not self.n:
            return
        begin = count = np.zeros(self.n, dtype=np.int64)
        while True:
            shared = ~(both ^ either)
            self.levels.append((begin, count, shared, both & shared))
            if len(both) == 1:
                break
            begin = np.arange(0, len(both), fanout)
            count = np.diff(np.append(begin, len(both)))
            both, either = np.bitwise_and.reduceat(both, begin), np.bitwise_or.reduceat(either, begin)
        for low in range(len(self.levels) - 1):  # what an upper node holds, those below it don't
            begin, count, mask, pattern = self.levels[low]
            above = np.repeat(self.levels[low + 1][2], self.levels[low + 1][1])
            self.levels[low] = (begin, count, mask & ~above, pattern & ~above)

    def search(self, codes: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index of the code, item) of all items whose shared bits differ in at most ``distance`` places; for fingerprints, the links."""
        for a in range(0, len(codes) if self.n else 0, SEARCHES):
            who = np.arange(a, min(len(codes), a + SEARCHES))
            stack = [(len(self.levels) - 1, who, np.zeros(len(who), dtype=np.int64), np.zeros(len(who), dtype=np.int64))]
            while stack:
                level, who, node, sofar = stack.pop()
                if len(who) > ROWS:
                    half = len(who) // 2
                    stack += [(level, who[half:], node[half:], sofar[half:]), (level, who[:half], node[:half], sofar[:half])]
                    continue
                begin, count, mask, pattern = self.levels[level]
                sofar = sofar + np.bitwise_count((codes[who] ^ pattern[node]) & mask[node])
                stay = sofar <= distance
                self.visited += len(who)
                self.pruned += len(who) - int(stay.sum()) if level or self.groups else 0
                who, node, sofar = who[stay], node[stay], sofar[stay]
                if level == 0:
                    yield who, node
                    continue
                n = count[node]
                below = np.repeat(begin[node] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                stack.append((level - 1, np.repeat(who, n), below, np.repeat(sofar, n)))


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the labels of linked entries in place; a label is the smallest entry reached."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def link_range(distance: int):
    """Rows sorted by (range, visitor or not) -> edges that join what is linked within a range and by its visitors, by mixed codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, tree, entries, label = None, [], None, np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(mixed(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

        def grown() -> pa.RecordBatch:
            nonlocal tree, entries, label, parts
            entries, parts = np.concatenate(parts) if parts else np.zeros(0, np.uint64), []
            entries = entries[np.argsort(gray_rank(entries))]
            tree, label = GrayTree(entries), np.arange(len(entries))
            for a, b in tree.search(entries, distance):
                join_labels(label, a[a < b], b[a < b])
            i = np.flatnonzero(label != np.arange(len(label)))
            return edges(entries[i], entries[label[i]])

        for batch in batches:
            group, visits = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            code = batch.column(2).to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (visits[1:] != visits[:-1])])) if len(group) else []
            for a, b in zip(cuts, [*cuts[1:], len(group)]):
                if group[a] != now:
                    if parts:
                        yield grown()
                    now, parts, tree = group[a], [], None
                if not visits[a]:
                    parts.append(code[a:b])
                    continue
                if tree is None:
                    yield grown()
                for who, item in tree.search(code[a:b], distance):
                    met = np.unique(np.stack([who, label[item]]), axis=1)  # one edge for each component
                    yield edges(code[a:b][met[0]], entries[met[1]])
        if parts:
            yield grown()

    return run


class Upper:
    """The upper nodes: ranges of slots (leading bits of a Gray rank) with the bits that their fingerprints share."""

    def __init__(self, slot: np.ndarray, count: np.ndarray, both: np.ndarray, either: np.ndarray, size: int | None = None):
        size = min(RANGE, -(-int(count.sum()) // RANGES)) if size is None else size
        order = np.argsort(slot)
        slot, count, both, either = slot[order], count[order], both[order], either[order]
        begin, held = [], size
        for i, n in enumerate(count.tolist()):
            if held + n > size:
                begin.append(i)
                held = 0
            held += n
        begin = np.array(begin, dtype=np.int64)
        self.first = slot[begin]
        self.tree = GrayTree(np.bitwise_and.reduceat(both, begin), np.bitwise_or.reduceat(either, begin)) if len(begin) else GrayTree(both)

    def own(self, code: np.ndarray) -> np.ndarray:
        """The range of each fingerprint."""
        return np.searchsorted(self.first, slot_of(code), side="right") - 1

    def routed(self, code: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index of the code, range) of the later ranges that may hold a link."""
        own = self.own(code)
        for who, group in self.tree.search(code, distance):
            later = group > own[who]
            yield who[later], group[later]


def slot_of(code: np.ndarray) -> np.ndarray:
    return (gray_rank(code) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def upper_nodes(codes: DataFrame) -> Upper:
    """The upper nodes over distinct fingerprints. The driver gets at most 2 ** SLOT_BITS counts with the AND and OR of a slot's fingerprints, whatever the input's size."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(slot_of(batch.column(0).to_numpy().view(np.uint64))), batch.column(0)], names=["slot", "code"])

    rows = codes.select("code").mapInArrow(frugal(slots), "slot long, code long").groupBy("slot").agg(F.count("*").alias("n"), F.bit_and("code").alias("x"), F.bit_or("code").alias("y")).toPandas()
    return Upper(*(rows[c].to_numpy(dtype=np.int64) for c in ("slot", "n")), *(rows[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("x", "y")))


def mixed(code: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit codes that mixes their order."""
    x = (code ^ (code >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, code): fingerprints as signed longs; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = fingerprints(batch.column(1).to_pylist(), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], names=["id", "code"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(frugal(run), f"id {kind}, code long")


def linked(codes: DataFrame, distance: int) -> DataFrame:
    """(code, root) for all of the distinct codes that have a link: the components' mixed roots."""
    spark = codes.sparkSession
    upper = spark.sparkContext.broadcast(upper_nodes(codes))  # at most 2 ** SLOT_BITS ranges; far fewer as a rule

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(group: np.ndarray, visits: bool, code: np.ndarray) -> pa.RecordBatch:
            made = (group.astype(np.int32), np.full(len(code), visits), code.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["grp", "visits", "code"])

        for batch in batches:
            code = batch.column(0).to_numpy().view(np.uint64)
            yield rows(upper.value.own(code), False, code)
            for who, group in upper.value.routed(code, distance):
                yield rows(group, True, code[who])

    dealt = codes.select("code").mapInArrow(frugal(routed), "grp int, visits boolean, code long").repartition(partitions_for(spark), "grp").sortWithinPartitions("grp", "visits")
    return components(dealt.mapInArrow(frugal(link_range(distance)), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 2) -> DataFrame:
    """One row per document: id, code (long), component_id (the smallest id of its component)."""
    rows = written(with_fingerprints(docs, id_col, text_col, size), "fingerprints")

    def add_vertex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vertex = mixed(batch.column(0).to_numpy().view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vertex)], names=["code", "least", "v"])

    kind = rows.schema["id"].dataType.simpleString()
    entries = written(rows.groupBy("code").agg(F.min("id").alias("least")).mapInArrow(add_vertex, f"code long, least {kind}, v long"), "entries")
    rooted = entries.join(linked(entries, distance), "v", "left").select("code", "least", F.coalesce("root", "v").alias("root"))
    rooted = written(rooted, "rooted")
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(groups, "root").select("code", "component_id")
    return rows.join(named, "code", "left").select(F.col("id").alias(id_col), "code", "component_id")


def hex_digits(code: Column) -> Column:
    """16 lower-case hex digits of a code."""
    return F.lower(F.lpad(F.hex(code), 16, "0"))
