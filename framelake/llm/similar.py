"""Near-duplicates: candidates by SimHash and by min-hash bands, links by the exact similarity of five-word shingles.

SimHash (``simhash.linked``, five-word fingerprints at two bits) proposes what its
Gray-order index links. A pair at similarity 0.8 lies some ten bits apart, where
no index of 64-bit fingerprints can be searched, so banded min-hashes propose the
rest: ``BANDS`` keys of ``ROWS`` minima each, of which a pair at 0.8 shares none
with probability 0.0007 (less above it). Documents that share keys, directly or
through others, form a candidate group; within it two are linked if and only if
the Jaccard similarity of their shingle sets is 0.8 or more. Components of these
links are the result. Documents with the same set of shingles are one entry.

A candidate group of more than ``GROUP`` shingles is dealt to chunks, and no task
holds more than one:

1. In each chunk an entry is compared with all that it is not yet linked to.
2. The most central entries of the chunks' components are compared, which joins
   what has a common centre.
3. Entries outside a group's largest component are streamed through all other
   chunks. Of two linked entries that are not joined yet, at least one is such, so
   no link is missed.

All but the last join runs while the plan is made.

Defined results: texts without words have similarity 1 with one another. Ids must
not be null. Repeated rows give repeated rows; an empty table an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, frugal, partitions_for, written
from .components import components
from .pretoken import slices
from .simhash import fingerprints_of, linked, mixed, shingle_hashes

#: Words of a shingle, and the least similarity (as a fraction) of linked documents.
SIZE, LEAST = 5, (4, 5)
#: Keys of a document and minima in each.
BANDS, ROWS = 40, 8
#: Bits by which SimHash fingerprints may differ, shingles of a chunk, and entries of a chunk's component that stand for it.
BITS, GROUP, CORES = 2, 4_000_000, 4
#: Characters worked on at once, shingles hashed at once, and postings looked at once. They bound memory only.
RUN, SHINGLES, POSTINGS = 2_000_000, 50_000, 2_000_000


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted different shingle hashes; one zero for a text without words."""
    return set_of(shingle_hashes(text, SIZE))


def set_of(found: list[int]) -> np.ndarray:
    return np.unique(np.array(found, dtype=np.uint64)) if found else np.zeros(1, np.uint64)


def entry_of(shingles: np.ndarray) -> int:
    """A 64-bit hash of a shingle set."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), 7)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BANDS`` keys per set."""
    random = np.random.default_rng(11)
    times, plus = (random.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
    times |= np.uint64(1)
    out = np.zeros((len(sets), BANDS), dtype=np.uint64)
    begin = 0
    while begin < len(sets):
        end, count = begin, 0
        while end < len(sets) and (end == begin or count + len(sets[end]) <= SHINGLES):
            count += len(sets[end])
            end += 1
        flat = np.concatenate(sets[begin:end])
        at = np.cumsum([0, *map(len, sets[begin : end - 1])])
        for i in range(BANDS * ROWS):
            band = i // ROWS
            least = np.minimum.reduceat(mixed(flat * times[i] + plus[i]), at)
            out[begin:end, band] = mixed(out[begin:end, band] + least + np.uint64(i))
        begin = end
    return out


def clusters(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the index of its component's first; links are pairs of at least ``LEAST`` similarity.

    A search over the links: each set is compared with all that no search has reached.
    """
    m, (p, q) = len(sets), LEAST
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    label = np.full(m, -1, dtype=np.int64)
    indexed = None

    for start in range(m):
        if label[start] >= 0:
            continue
        label[start], stack = start, [start]
        while stack:
            i = stack.pop()
            left = np.flatnonzero(label < 0)
            if not len(left):
                break
            if indexed is None or 2 * len(left) <= indexed:  # those reached since go out of the index
                flat, owner = np.concatenate([sets[x] for x in left]), np.repeat(left, sizes[left])
                order = np.argsort(flat, kind="stable")
                flat, owner, indexed = flat[order], owner[order], len(left)
            lo = np.searchsorted(flat, sets[i], "left")
            n = np.searchsorted(flat, sets[i], "right") - lo
            lo, n = lo[n > 0], n[n > 0]
            shared, a = np.zeros(m, dtype=np.int64), 0
            ends = np.cumsum(n)
            while a < len(n):
                done = int(ends[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(ends, done + POSTINGS, "right")))
                part = n[a:b]
                shared += np.bincount(owner[np.repeat(lo[a:b] - (np.cumsum(part) - part), part) + np.arange(int(part.sum()))], minlength=m)
                a = b
            near = np.flatnonzero((label < 0) & ((p + q) * shared >= p * (sizes[i] + sizes)))  # shared / union >= p / q
            label[near] = start
            stack += near.tolist()
    return label


def central(sets: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Whether a set is among the ``CORES`` of its component that share most with the others of it."""
    out = np.zeros(len(sets), dtype=bool)
    order = np.argsort(label, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        if len(own) <= CORES:
            out[own] = True
            continue
        sizes = np.array([len(sets[i]) for i in own], dtype=np.int64)
        _, which, times = np.unique(np.concatenate([sets[i] for i in own]), return_inverse=True, return_counts=True)
        shared = np.add.reduceat(times[which], np.cumsum(sizes) - sizes) / len(own)
        out[own[np.argsort(-shared / (sizes + sizes.mean() - shared), kind="stable")[:CORES]]] = True
    return out


SIGNED = "v long, size long, code long, mcode long, keys array<long>"


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, SIGNED), some texts at a time."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in slices([t or "" for t in texts], RUN):
            hashes = [shingle_hashes(t, SIZE) for t in texts[a:b]]
            code = fingerprints_of(hashes)
            sets = [set_of(h) for h in hashes]
            del hashes
            v = np.array([entry_of(s) for s in sets], dtype=np.uint64).view(np.int64)
            keys = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, band_keys(sets).view(np.int64).ravel())
            made = (v, np.array([len(s) for s in sets], dtype=np.int64), code.view(np.int64), mixed(code).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, made), keys], names=["id", "v", "size", "code", "mcode", "keys"])


def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, v) -> (a, b): each entry of a key with the one before it."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if last is not None:
            key, v = np.append(last[0], key), np.append(last[1], v)
        last = key[-1:], v[-1:]
        same = np.flatnonzero((key[1:] == key[:-1]) & (v[1:] != v[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(v[same]), pa.array(v[same + 1])], names=["a", "b"])


JUDGED = "v long, c long, core boolean, root long, chunk long, chunks long"


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (root, chunk, v, chunks, text) -> JUDGED: the component of each entry within its chunk of a candidate group."""
    now, entries, sets = None, [], []

    def settled() -> pa.RecordBatch:
        names, label = np.array(entries, dtype=np.int64), clusters(sets)
        n = len(names)
        core = central(sets, label) if now[2] > 1 else np.zeros(n, dtype=bool)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (names, names[label], core, *(np.full(n, i, dtype=np.int64) for i in now))], names=["v", "c", "core", "root", "chunk", "chunks"])

    for batch in batches:
        for r, k, v, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (r, k, n) != now:
                if entries:
                    yield settled()
                now, entries, sets = (r, k, n), [], []
            if not entries or v != entries[-1]:
                entries.append(v)
                sets.append(shingle_set(text))
    if entries:
        yield settled()


def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (root, chunk, visits, v, component, text) -> (a, b): links of visitors with a chunk's entries of other components."""
    p, q = LEAST
    now, names, parts, owner, sets, sizes, flat = None, [], [], [], [], None, None
    for batch in batches:
        out_a, out_b = [], []
        for r, k, visits, v, component, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (r, k) != now:
                now, names, parts, sets, flat = (r, k), [], [], [], None
            own = shingle_set(text)
            if not visits:
                if not names or names[-1] != v:
                    names.append(v)
                    parts.append(component)
                    sets.append(own)
                continue
            if flat is None:
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                flat, owner = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes)
                order = np.argsort(flat, kind="stable")
                flat, owner, sets = flat[order], owner[order], []
                whose, named = np.array(parts, dtype=np.int64), np.array(names, dtype=np.int64)
            lo = np.searchsorted(flat, own, "left")
            n = np.searchsorted(flat, own, "right") - lo
            shared = np.zeros(len(sizes), dtype=np.int64)
            ends, a = np.cumsum(n), 0
            while a < len(n):
                b = max(a + 1, int(np.searchsorted(ends, (int(ends[a - 1]) if a else 0) + POSTINGS, "right")))
                part = n[a:b]
                shared += np.bincount(owner[np.repeat(lo[a:b] - (np.cumsum(part) - part), part) + np.arange(int(part.sum()))], minlength=len(sizes))
                a = b
            near = np.flatnonzero(((p + q) * shared >= p * (sizes + len(own))) & (whose != component))
            _, first = np.unique(whose[near], return_index=True)
            out_a += [v] * len(first)
            out_b += named[near[first]].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row per document: id, component_id (the smallest id of its component)."""
    kind, n = docs.schema[id_col].dataType.simpleString(), partitions_for(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = written(texts.mapInArrow(frugal(signed), f"id {kind}, {SIGNED}"), "shingled")
    entries = written(rows.groupBy("v").agg(F.min("id").alias("least"), *(F.first(c).alias(c) for c in ("size", "code", "mcode", "keys"))), "entries")
    simhash = linked(entries.select("code").distinct(), BITS).select(F.col("v").alias("mcode"), "root")
    hashed = entries.select("v", "mcode").join(simhash, "mcode", "left").select(F.xxhash64(F.lit("simhash"), F.coalesce("root", "mcode")).alias("key"), "v")
    dealt = entries.select(F.explode("keys").alias("key"), "v").union(hashed).repartition(n, "key").sortWithinPartitions("key", "v")
    candidates = written(components(dealt.mapInArrow(frugal(paths), "a long, b long")).join(entries.select("v", "least", "size"), "v"), "candidates")

    # groups of several chunks: at most one for each ``group`` shingles
    large = written(candidates.groupBy("root").agg(F.sum("size").alias("s")).where(F.col("s") > group).select("root", F.ceil(F.col("s") / group).alias("chunks")), "large")
    some = large.count()
    chunked = candidates.join(F.broadcast(large) if some <= 100_000 else large, "root", "left")
    chunked = chunked.select(F.col("least").alias("id"), "v", "root", F.coalesce("chunks", F.lit(1)).alias("chunks")).withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")))
    compared = texts.join(chunked, "id").select("root", "chunk", "v", "chunks", "text")
    in_chunks = lambda rows: rows.repartition(n, "root", "chunk").sortWithinPartitions("root", "chunk", "v").mapInArrow(frugal(verified), JUDGED)
    if some:
        compared = written(compared, "compared")
    judged = in_chunks(compared)
    if some:
        judged = written(judged, "judged")
        named_large = joined_chunks(compared.where("chunks > 1"), judged.where("chunks > 1"), in_chunks, n)
        judged = judged.where("chunks = 1").select("v", "c").union(named_large)
    named = written(entries.select("v", "least").join(judged.select("v", "c"), "v", "left").select("v", "least", F.coalesce("c", "v").alias("c")), "linked")
    forget(candidates, large, *([compared] if some else []))
    groups = named.groupBy("c").agg(F.min("least").alias("component_id"))
    return rows.select("id", "v").join(named.join(groups, "c").select("v", "component_id"), "v").select(F.col("id").alias(id_col), "component_id")


def joined_chunks(compared: DataFrame, judged: DataFrame, in_chunks, n: int) -> DataFrame:
    """(v, c) of the groups of several chunks, from the components of their chunks."""
    cores = compared.join(judged.where("core").select("v"), "v", "left_semi").select("root", "chunk", "v", "chunks", "text")
    shares = judged.where("core").groupBy("root").agg(F.count("*").alias("m"))
    dealt = cores.drop("chunks", "chunk").join(shares, "root").withColumn("chunks", F.ceil(F.col("m") / 2000)).withColumn("chunk", F.pmod(F.xxhash64("v", F.lit(1)), F.col("chunks")))
    centres = in_chunks(dealt.select("root", "chunk", "v", "chunks", "text"))
    every = judged.select(F.col("v").alias("a"), F.col("c").alias("b"))
    edges = written(every.union(centres.select("v", "c")), "edges")
    placed = judged.select("v", "root", "chunk", "chunks").join(components(edges).withColumnRenamed("root", "part"), "v", "left").withColumn("part", F.coalesce("part", "v"))
    placed = written(placed, "placed")
    most = placed.groupBy("root", "part").count().groupBy("root").agg(F.max_by("part", F.struct("count", "part")).alias("most"))
    entries = compared.select("v", "text").join(placed.join(most, "root"), "v")
    visitors = entries.where(F.col("part") != F.col("most")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1))).where(F.col("at") != F.col("chunk"))
    rows = entries.select("root", F.col("chunk").cast("long").alias("chunk"), F.lit(False).alias("visits"), "v", "part", "text").union(visitors.select("root", F.col("at").cast("long"), F.lit(True), "v", "part", "text"))
    met = rows.repartition(n, "root", "chunk").sortWithinPartitions("root", "chunk", "visits", "v").mapInArrow(frugal(crossed), "a long, b long")
    found = components(edges.union(met)).withColumnRenamed("root", "part")
    return judged.select("v").join(found, "v", "left").select("v", F.coalesce("part", "v").alias("c"))
