"""Exact removal of byte strings that start earlier in the corpus, with a run-length compressed index.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (a
smaller document id, or the same document and an earlier start). All strings are
judged on the input.

Five steps, none of which pairs documents:

1. Anchors. Every window of LENGTH bytes is owned by its k-mer of least hash (the
   leftmost of equals), so equal windows have equal owners at equal places. An
   anchor is such a k-mer; its stretch is what its windows cover. A task drops
   all but the first of equal stretches before the shuffle, for the others are
   known to start earlier. The anchors are written and counted by slots of their
   hash; those in a slot of over ``HEAVY`` are heavy.
2. One shuffle by anchor (heavy ones by anchor and stretch, so that no anchor
   comes to one task). Of stretches with equal hash all but the first go.
   Anchors with several different stretches need a closer look.
3. The stretches of those anchors, fetched from their texts, come together by
   anchor in a run-compressed Burrows-Wheeler index (``RunIndex``). It keeps
   samples where runs begin; streaming them through the text yields the matching
   statistics of every position, and windows that match over at least LENGTH
   bytes fall into classes of which all but the first member go.
4. Stretches of heavy anchors are taken apart into their windows, which meet by a
   128-bit hash; all but the first go.
5. The spans meet their text, which is cut.

Stretches are compared by a 64-bit hash under an equal 64-bit anchor hash. Steps
1 and 2 run while the plan is made.

Defined results: a null text has no bytes. Rows of one document id whose texts
are equal count as one document and get the same result each; if their texts
differ (by a 79-bit hash), they follow each other in the order of a hash of the
text. A null id comes before all others. Empty tables give empty results.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, frugal, partitions_for, written
from .pretoken import gather

LENGTH, ANCHOR = 100, 24
#: Bytes that numpy works on at once, and of stretches that are indexed together (an anchor's own stay together).
PIECE, INDEXED = 1_000_000, 500_000
#: Occurrences in a slot beyond which its anchors are dealt by stretch and judged by windows; both ways give the same spans.
HEAVY = 4096
NO_ID = -(2**63)
ANCHOR_ROWS = "key long, ctx long, doc long, mark long, packed long, spans binary"
FOUND_ROWS = "doc long, mark long, sub int, key long, packed long, spans binary, heavy boolean"
STRETCH_ROWS = "key long, ctx long, doc long, mark long, packed long, piece binary, gone boolean"


# --- windows and their anchors ---


def kmer_hashes(data: np.ndarray, k: int = ANCHOR) -> np.ndarray:
    """A mixed 32-bit hash of every k-mer, by doubling."""
    letters = np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.uint32)
    power = lambda e: np.uint32(pow(0x9E3779B1, e, 2**32))
    part, size, out, have = letters[data], 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, have = part, size
            else:
                n = len(out) - size
                out = out[:n] * power(size) + part[have : have + n]
                have += size
        if 2 * size > k:
            break
        part = part[:-size] * power(size) + part[size:]
        size *= 2
    x = out
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return x ^ (x >> np.uint32(16))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, values
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces that lie end to end: each anchor, and the first and last window start that it owns."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none, none, none
    tagged = (kmer_hashes(data).astype(np.uint64) << np.uint64(32)) | np.arange(len(data) - ANCHOR + 1, dtype=np.uint64)
    owner = (sliding_min(tagged, LENGTH - ANCHOR + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(owner) + 1, dtype=np.int32)
    begin, end = bounds[:-1], bounds[1:] - LENGTH + 1
    has = end > begin
    np.add.at(inside, begin[has], 1)
    np.add.at(inside, end[has], -1)
    start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(start):
        return none, none, none
    own = owner[start]
    change = np.flatnonzero((own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    first, last = np.concatenate([[0], change]), np.concatenate([change, [len(start)]]) - 1
    return own[first], start[first], start[last]


def pack_place(sub: np.ndarray, at: np.ndarray, back: np.ndarray, near: np.ndarray) -> np.ndarray:
    """16 bits that part texts of one id, 32 of the anchor's place, 7 and 7 back to the first and last window it owns."""
    return (sub << 46) | (at << 14) | (back << 7) | near


def unpack_place(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The 16 bits, the anchor's place, the first and the last window start."""
    at = (packed >> 14) & 0xFFFFFFFF
    return packed >> 46, at, at - ((packed >> 7) & 127), at - (packed & 127)


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of a union of ranges."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    fresh = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[fresh], hi[np.append(np.flatnonzero(fresh)[1:] - 1, len(hi) - 1)]


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and where each text begins (and the end); nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def pieces(at: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Runs of (text, from, to) of about PIECE bytes; long texts are cut so that each window lies whole in one piece."""
    held, group = 0, []
    for i, n in enumerate(np.diff(at).tolist()):
        if n < LENGTH:
            continue
        for a in range(0, n - LENGTH + 1, PIECE):
            b = min(n, a + PIECE + LENGTH - 1)
            if group and held + b - a > PIECE:
                yield group
                held, group = 0, []
            group.append((i, a, b))
            held += b - a
    if group:
        yield group


def emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, mark, sub, text) -> anchors that the task cannot settle, and per text the spans that it can."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        doc, mark, sub = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        data, at = raw_texts(batch.column(3))
        for group in pieces(at):
            which, begin, end = np.array(group, dtype=np.int64).T
            raw = gather(data, at[which] + begin, end - begin)
            bounds = np.concatenate([[0], np.cumsum(end - begin)])
            place, lo, hi = anchors(raw, bounds)
            if not len(place):
                continue
            piece = np.searchsorted(bounds, lo, side="right") - 1
            text = which[piece]
            shift = begin[piece] - bounds[piece]
            view = raw.tobytes()
            key = np.array([digest(view[j : j + ANCHOR]) for j in place.tolist()], dtype=np.uint64).view(np.int64)
            ctx = np.array([digest(view[a : b + LENGTH], j - a) for j, a, b in zip(place.tolist(), lo.tolist(), hi.tolist(), strict=True)], dtype=np.uint64).view(np.int64)
            packed = pack_place(sub[text], place + shift, place - lo, place - hi)
            order = np.lexsort((packed, mark[text], doc[text], ctx, key))
            k, c, d, m, p = key[order], ctx[order], doc[text][order], mark[text][order], packed[order]
            again = np.concatenate([[False], (k[1:] == k[:-1]) & (c[1:] == c[:-1])])
            yield anchor_rows(k[~again], c[~again], d[~again], m[~again], p[~again])
            gone = order[again]
            head = np.flatnonzero(~again)[np.cumsum(~again)[again] - 1]
            gone = gone[(d[again] != d[head]) | (m[again] != m[head]) | (p[again] != p[head])]  # else a repeated row
            if len(gone):
                gone = gone[np.argsort(text[gone], kind="stable")]
                texts, cut = np.unique(text[gone], return_index=True)
                spans = []
                for own in np.split(gone, cut[1:]):
                    a, b = merged(lo[own] + shift[own], hi[own] + shift[own] + LENGTH)
                    spans.append(np.stack([a, b], axis=1).astype("<i8").tobytes())
                # dealt by the text's hash; no heavier for a slot than a text is
                yield anchor_rows(mark[texts], np.zeros(len(texts), np.int64), doc[texts], mark[texts], sub[texts] << 46, spans)


def rows_of(schema: str, *columns) -> pa.RecordBatch:
    """A batch from numpy arrays, Arrow arrays, or None for nulls; the first column gives the length."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    n = len(columns[0])
    made = [pa.nulls(n, kinds[t]) if c is None else c if isinstance(c, pa.Array) else pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(made, names=list(names))


def anchor_rows(key, ctx, doc, mark, packed, spans: list[bytes] | None = None) -> pa.RecordBatch:
    return rows_of(ANCHOR_ROWS, key, ctx, doc, mark, packed, spans)


# --- equal stretches ---


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted anchors -> spans of all but the first of equal stretches, and the first ones of anchors with several or heavy ones."""
    last = None  # the first row of the group of equal stretches that the batch before ended in, and if it has been emitted
    for batch in batches:
        spans = batch.column(5)
        given = np.asarray(spans.is_valid())
        if given.any():
            own = batch.filter(pa.array(given))
            yield found_rows(own.column(2).to_numpy(), own.column(3).to_numpy(), own.column(4).to_numpy() >> 46, None, None, own.column(5))
        k, c, d, m, p, w = (batch.column(i).to_numpy(zero_copy_only=False)[~given] for i in (0, 1, 2, 3, 4, 6))
        if not len(k):
            continue
        carried = last is not None
        if carried:
            k, c, d, m, p, w = (np.concatenate([[x], y]) for x, y in zip(last[:6], (k, c, d, m, p, w), strict=True))
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
        head = np.flatnonzero(fresh)
        first = head[np.cumsum(fresh) - 1]
        gone = ~fresh & ((d != d[first]) | (m != m[first]) | (p != p[first]))
        yield found_rows(d[gone], m[gone], p[gone] >> 46, None, p[gone])
        kh = k[head]
        same = kh[1:] == kh[:-1]
        several = np.concatenate([same, [False]]) | np.concatenate([[False], same]) | w[head].astype(bool)
        done = carried and last[6]
        ended = bool(several[-1]) or (done and len(head) == 1)
        if done:
            several[0] = False
        chosen = head[several]
        yield found_rows(d[chosen], m[chosen], p[chosen] >> 46, k[chosen], p[chosen], None, w[chosen].astype(bool))
        h = head[-1]
        last = (k[h], c[h], d[h], m[h], p[h], w[h], ended)


def found_rows(doc, mark, sub, key, packed, spans: pa.Array | None = None, heavy=None) -> pa.RecordBatch:
    return rows_of(FOUND_ROWS, doc, mark, sub.astype(np.int32), key, packed, spans, heavy)


# --- the run-length index ---


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of some byte strings, sampled where runs begin.

    ``strings`` lie end to end in ``data``; a mark after each makes every suffix
    differ from all others within its string. The suffixes are sorted once, by
    prefix doubling; what is kept is, for each run of the transform, its byte and
    length, the suffix where it begins, the suffix sorted before that one, and the
    length of their common prefix. From a sampled position on, both suffixes move
    by one with each position until the next sample, and the prefix shrinks by
    one: so the samples give every position's matching statistics (the longest
    match with another suffix, and that suffix) in one pass over the text.
    """

    def __init__(self, data: np.ndarray, length: np.ndarray):
        n = int(length.sum()) + len(length)
        self.end = np.cumsum(length + 1) - 1  # the marks
        text = np.full(n + 8, 0xFF, dtype=np.uint8)  # a byte that UTF-8 never has
        inside = np.ones(n, dtype=bool)
        inside[self.end] = False
        text[:n][inside] = data
        self.text, self.n = text, n
        self.to_end = np.repeat(self.end, length + 1) - np.arange(n)
        order = self._sorted()
        before = text[order - 1].copy()  # the last mark precedes the first suffix
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = (before[1:] != before[:-1]) | (before[1:] == 0xFF)  # each mark is a run of its own
        heads = np.flatnonzero(fresh)
        self.run_byte, self.run_length = before[heads], np.diff(np.append(heads, n))
        self.at = order[heads]
        self.other = np.append([n], order[heads[1:] - 1]) if len(heads) else heads  # the first suffix has none before it
        self.common = np.zeros(len(heads), dtype=np.int64)
        self.common[1:] = self._compared(self.at[1:], self.other[1:])
        by_place = np.argsort(self.at)
        self.at, self.other, self.common = self.at[by_place], self.other[by_place], self.common[by_place]

    def _eight(self, at: np.ndarray) -> np.ndarray:
        return np.ndarray(self.n, dtype=">u8", buffer=self.text, strides=(1,))[at].astype(np.uint64)

    def _sorted(self) -> np.ndarray:
        """The suffix array."""
        n, to_end = self.n, self.to_end
        eight = self._eight(np.arange(n))
        spare = (8 * np.clip(7 - to_end, 0, 7)).astype(np.uint64)
        eight = (eight >> spare) << spare  # bytes after the mark don't count
        order = np.argsort(eight, kind="stable")  # suffixes that are equal up to their marks stay in the marks' order
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = (eight[order][1:] != eight[order][:-1]) | (to_end[order][1:] < 8)
        rank = np.empty(n, dtype=np.int64)

        def grouped(fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Where each one's group begins, and whether it has company."""
            begin = np.flatnonzero(fresh)
            size = np.diff(np.append(begin, len(fresh)))
            return np.repeat(begin, size), np.repeat(size > 1, size)

        begin, several = grouped(fresh)
        rank[order] = begin
        at, step = order[several], 8
        while len(at):
            own = rank[at]
            key = own * n + rank[np.minimum(at + step, n - 1)]
            by = np.argsort(key)
            at, own, key = at[by], own[by], key[by]
            base, _ = grouped(np.concatenate([[True], own[1:] != own[:-1]]))
            lead, several = grouped(np.concatenate([[True], key[1:] != key[:-1]]))
            rank[at] = own + (lead - base)
            at = at[several]
            step *= 2
        order[rank] = np.arange(n)
        return order

    def _compared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, eight bytes at a time; a mark equals nothing."""
        out = np.zeros(len(a), dtype=np.int64)
        room = np.minimum(self.to_end[a], self.to_end[b])
        going = np.arange(len(a))
        while len(going):
            x, y = a[going] + out[going], b[going] + out[going]
            differs = self._eight(x) ^ self._eight(y)
            zero, low = differs == 0, np.zeros(len(going), dtype=np.int64)
            for half in (4, 2, 1):  # equal bytes at the front
                same = differs >> np.uint64(64 - 8 * half) == 0
                low[same] += half
                differs = np.where(same, differs << np.uint64(8 * half), differs)
            out[going] += np.where(zero, 8, low)
            over = out[going] >= room[going]
            out[going[over]] = room[going[over]]
            going = going[zero & ~over]
        return out

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position: the common prefix with the suffix sorted before it, and that suffix."""
        every = np.arange(self.n)
        sample = np.searchsorted(self.at, every, side="right") - 1
        moved = every - self.at[sample]
        match = np.maximum(self.common[sample] - moved, 0)
        return match, np.where(match > 0, self.other[sample] + moved, every)

    def repeats(self, length: int) -> np.ndarray:
        """Positions whose next ``length`` bytes also stand at a smaller position."""
        match, up = self.statistics()
        up = np.where(match >= length, up, np.arange(self.n))
        while True:  # to the first suffix of the class in sorted order
            further = up[up]
            if np.array_equal(further, up):
                break
            up = further
        least = np.full(self.n, self.n, dtype=np.int64)
        np.minimum.at(least, up, np.arange(self.n))
        return np.flatnonzero(least[up] != np.arange(self.n))


def first_of_equals(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc, mark, packed) of all but the first of windows with equal hash, from sorted rows."""
    last = None
    for batch in batches:
        k, c, d, m, p, g = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 4, 6))
        g = g.astype(bool)
        yield d[g], m[g], p[g]
        k, c, d, m, p = (x[~g] for x in (k, c, d, m, p))
        if not len(k):
            continue
        if last is not None:
            k, c, d, m, p = (np.concatenate([[x], y]) for x, y in zip(last, (k, c, d, m, p), strict=True))
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
        first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        gone = ~fresh & ((d != d[first]) | (m != m[first]) | (p != p[first]))
        yield d[gone], m[gone], p[gone]
        h = int(first[-1])
        last = (k[h], c[h], d[h], m[h], p[h])


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by anchor, document and place, and windows sorted by hash -> spans of windows that start earlier in another."""

    def judge(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        doc, mark, packed = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))
        length = np.array([len(r[3]) for r in rows], dtype=np.int64)
        index = RunIndex(np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8), length)
        at = index.repeats(LENGTH)
        row = np.searchsorted(index.end, at)
        sub, _, lo, _ = unpack_place(packed[row])
        start = lo + at - (index.end[row] - length[row])
        fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]) if len(at) else np.zeros(0, bool)
        a = np.flatnonzero(fresh)
        b = np.append(a[1:] - 1, len(at) - 1) if len(a) else a
        spans = [np.array([x, y + LENGTH], dtype="<i8").tobytes() for x, y in zip(start[a].tolist(), start[b].tolist(), strict=True)]
        return found_rows(doc[row[a]], mark[row[a]], sub[a], None, None, pa.array(spans, pa.binary()))

    def windows() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.asarray(batch.column(5).is_null())
            stretches.append(batch.filter(pa.array(~whole)))
            yield batch.filter(pa.array(whole))

    stretches: list[pa.RecordBatch] = []
    held, group, size, own, now = [], [], 0, 0, None
    for d, m, p in first_of_equals(windows()):
        yield found_rows(d, m, p >> 46, None, p)
        while stretches:
            for key, _, d, m, p, piece, _ in zip(*(c.to_pylist() for c in stretches.pop(0).columns), strict=True):
                if key != now:
                    held.extend(group)
                    size, own, group, now = size + own, 0, [], key
                    if size > INDEXED:
                        yield judge(held)
                        held, size = [], 0
                if group and group[-1][:3] == (d, m, p):
                    continue  # a repeated row
                group.append((d, m, p, piece))
                own += len(piece)
    if held or group:
        yield judge(held + group)


# --- texts and what belongs to them ---


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle, after whatever further columns there are."""
    make = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = [make(t or b"") for t in batch.column(3).cast(pa.binary()).to_pylist()]
        n = len(texts)
        empty = [pa.nulls(n, k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.bool_())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *empty, *batch.columns[4:], pa.array(texts, pa.binary())], names=["doc", "mark", "sub", "key", "packed", "spans", "heavy", *batch.schema.names[4:], "body"])


def window_rows(doc: int, mark: int, packed: int, data: bytes, lo: int, hi: int) -> Iterator[tuple]:
    """The windows of a stretch, by a 128-bit hash."""
    sub = packed >> 46
    for a in range(lo, hi + 1):
        h = xxhash.xxh3_128_intdigest(data[a : a + LENGTH])
        yield (h >> 64) - (1 << 63), (h & (2**64 - 1)) - (1 << 63), doc, mark, (sub << 46) | (a << 14), None, False


def thinned(rows: list[tuple]) -> list[tuple]:
    """Windows of a task without all but the first of equals, of which those of one stretch become one row each."""
    rows.sort(key=lambda r: r[:5])
    out, gone, last = [], [], None
    for r in rows:
        if last is not None and r[:2] == last[:2]:
            if r != last:
                gone.append(r)
        else:
            out.append(r)
            last = r
    gone.sort(key=lambda r: r[2:5])
    run: list[tuple] = []
    for r in [*gone, None]:
        if run and (r is None or r[2:4] != run[0][2:4] or r[4] - run[-1][4] > 1 << 14 or r[4] - run[0][4] > 127 << 14):
            first, end = run[0], run[-1]
            out.append((*first[:4], end[4] | ((end[4] - first[4]) >> 14) << 7, None, True))
            run = []
        if r is not None:
            run.append(r)
    return out


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a text's wanted stretches, then the text) -> the stretches' bytes, or their windows if heavy."""
    expand = zstandard.ZstdDecompressor().decompress
    now, wanted = None, []
    for batch in batches:
        out, windows = [], []
        for doc, mark, sub, key, packed, heavy, body in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6, -1)), strict=True):
            if (doc, mark, sub) != now:
                now, wanted = (doc, mark, sub), []
            if body is None:
                wanted.append((key, packed, heavy))
            elif wanted:
                data = expand(body)
                _, _, lo, hi = unpack_place(np.array([p for _, p, _ in wanted], dtype=np.int64))
                for (k, p, w), a, b in zip(wanted, lo.tolist(), hi.tolist(), strict=True):
                    if w:
                        windows += window_rows(doc, mark, p, data, a, b)
                    else:
                        out.append((k, 0, doc, mark, p, data[a : b + LENGTH], False))
                wanted = []
        out += thinned(windows)
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        yield rows_of(STRETCH_ROWS, *(list(c) for c in columns))


def cut_texts(batches: Iterator[pa.RecordBatch], as_text: bool = False) -> Iterator[pa.RecordBatch]:
    """Sorted (a text's spans, then the text) -> what is left of it; further columns are passed on.

    As text, the rest loses the bytes of characters that were cut in part.
    """
    expand = zstandard.ZstdDecompressor().decompress
    now, places, ranges = None, [], []
    for batch in batches:
        out, row = [], []
        for i, (doc, mark, sub, packed, spans, body) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, -1)), strict=True)):
            if (doc, mark, sub) != now:
                now, places, ranges = (doc, mark, sub), [], []
            if body is None:
                if packed is not None:
                    places.append(packed)
                else:
                    ranges.append(spans)
                continue
            data = expand(body)
            _, _, lo, hi = unpack_place(np.array(places, dtype=np.int64))
            both = np.frombuffer(b"".join(ranges), dtype="<i8").reshape(-1, 2)
            a, b = merged(np.concatenate([lo, both[:, 0]]), np.concatenate([hi + LENGTH, both[:, 1]]))
            cuts, at = [], 0
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                cuts.append(data[at:x])
                at = y
            kept = b"".join([*cuts, data[at:]]) if cuts else data
            out.append((None if mark < 0 else doc, len(data), len(data) - len(kept), len(a), kept.decode("utf-8", "ignore") if as_text else kept))
            row.append(i)
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary())
        rest = [c.take(pa.array(row, pa.int64())) for c in batch.columns[7:-1]]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), *rest], names=["doc", "n_bytes", "n_removed", "n_spans", "kept", *batch.schema.names[7:-1]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """One row per document: doc, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes; or text).

    Further columns named by ``keep`` come back as the struct ``rest``.
    """
    n = partitions_for(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = F.xxhash64(text).bitwiseAND(F.lit(2**63 - 1))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.when(F.col(id_col).isNull(), -1 - hashed).otherwise(hashed).alias("mark"),
        F.pmod(F.hash(text), F.lit(1 << 16)).cast("int").alias("sub"), F.col(text_col).alias("text"), *([F.struct(*keep).alias("rest")] if keep else []),
    )
    extra = "".join(f", rest {f.dataType.simpleString()}" for f in rows.schema if f.name == "rest")
    anchored = written(rows.select("doc", "mark", "sub", "text").mapInArrow(frugal(emit_anchors), ANCHOR_ROWS), "anchors")
    dealt = with_heavy(anchored).repartition(n, "key", F.when(F.col("heavy"), F.col("ctx"))).sortWithinPartitions("key", "ctx", "doc", "mark", "packed")
    found = written(dealt.mapInArrow(frugal(settle), FOUND_ROWS), "stretches")
    forget(anchored)
    owner = ["doc", "mark", "sub"]

    def with_texts(part: DataFrame, extra: str) -> DataFrame:
        """Rows of ``part`` before the text they belong to, dealt by text."""
        bodies = rows if extra else rows.select(*owner, "text")
        bodies = bodies.mapInArrow(frugal(squeeze), f"{FOUND_ROWS}{extra}, body binary")
        return part.unionByName(bodies, allowMissingColumns=True).select(*bodies.columns).repartition(n, *owner).sortWithinPartitions(*owner, F.col("body").isNotNull())

    stretches = with_texts(found.where("key IS NOT NULL"), "").mapInArrow(frugal(fetch), STRETCH_ROWS)
    closer = stretches.repartition(n, "key").sortWithinPartitions("key", "ctx", "doc", "mark", "packed").mapInArrow(frugal(compare), FOUND_ROWS)
    spans = found.where("key IS NULL").union(closer)
    return with_texts(spans, extra).mapInArrow(frugal(functools.partial(cut_texts, as_text=as_text)), f"doc long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}{extra}")


def with_heavy(anchored: DataFrame, heavy: int = HEAVY, broadcast: int = 100_000) -> DataFrame:
    """Adds whether an anchor's slot is heavy. There are four slots for each ``heavy`` anchors, so slots are as full at every size.

    Counts combine before their shuffle. The heavy slots (8 bytes each) are sent
    to all tasks if they are few, else joined.
    """
    slots = 1 << max(12, (4 * anchored.count() // heavy).bit_length())
    slot = F.col("key").bitwiseAND(F.lit(slots - 1))
    full = written(anchored.where("spans IS NULL").groupBy(slot.alias("slot")).count().where(F.col("count") > heavy).select("slot"), "heavy")
    marked = full.withColumn("heavy", F.lit(True))
    joined = anchored.withColumn("slot", slot).join(F.broadcast(marked) if full.count() <= broadcast else marked, "slot", "left")
    return joined.select(*anchored.columns, F.coalesce("heavy", F.lit(False)).alias("heavy"))
