"""Benchmark decontamination over a stored, document-sharded positional inverted index.

``build_index`` writes the postings of every term of the training texts: a shard
(a run of whole texts within a task) holds its terms, and for each term the
ascending positions at which it stands. A test phrase is looked up from the term
that is rarest in the shard: its list, moved by the term's offset, is intersected
with the offset-adjusted lists of the other terms in order of rarity, so a phrase
costs what its rarest term does. Shards are independent; nothing is shuffled.

Test phrases are shipped in parts of about ``PART`` characters of benchmark text;
a shard is judged with one part after another, whatever their number, and the
words that the parts cover are put together in the task. The driver turns one part
at a time into phrases.

Defined results: a null or empty text has no words and no hits. An item of fewer
words than a window is one window; an item without words has none. Items that
share an id count once; a null id reads as ''. Repeated documents give repeated
rows; empty tables give empty results or no hits. The index is written while the
plan is made.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, written
from .pretoken import gather, slices

#: Characters of benchmark text in a part and of documents in a shard (a longer one is alone), and candidates looked at together. They bound memory only.
PART, SHARD, CANDIDATES = 4_000_000, 1_000_000, 1_000_000

#: A-Z become lower case; all other ASCII but a-z and 0-9 becomes a space.
WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a-z, 0-9 and non-ASCII characters, with A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


@dataclass
class Phrases:
    """Distinct phrases of term numbers (padded with 0), their lengths, and the items each belongs to."""

    vocabulary: dict[bytes, int]
    terms: np.ndarray
    length: np.ndarray
    item_begin: np.ndarray
    item: np.ndarray
    names: list[str]

    @staticmethod
    def windows(items: Iterable[tuple[str | None, str | None]], size: int = 10) -> Phrases:
        """All windows of ``size`` consecutive words of each item."""
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        names: dict[str, int] = {}
        for name, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            who = names.setdefault("" if name is None else str(name), len(names))
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + size]), set()).add(who)
        longest = max(map(len, found), default=1)
        terms = np.array([p + (0,) * (longest - len(p)) for p in found], dtype=np.int32).reshape(len(found), longest)
        lists = [sorted(x) for x in found.values()]
        begin = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        return Phrases(vocabulary, terms, np.array([len(p) for p in found], dtype=np.int64), begin, np.array(list(chain.from_iterable(lists)), dtype=np.int64), list(names))


class PositionalShard:
    """The positions of every term of a run of texts, which lie end to end."""

    def __init__(self, bounds: np.ndarray, terms: list[bytes], counts: np.ndarray, postings: np.ndarray):
        self.bounds, self.terms, self.postings = bounds, terms, postings
        self.counts = counts.astype(np.int64)
        self.begin = np.cumsum(self.counts) - self.counts
        self.n = int(bounds[-1])
        self.keys = np.repeat(np.arange(len(terms), dtype=np.int64), self.counts) * (self.n + 1) + postings  # ascending
        self.number = dict(zip(terms, range(len(terms)), strict=True))

    @staticmethod
    def of(words: Sequence[list[bytes]]) -> PositionalShard:
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        token = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), dtype=np.int32, count=int(bounds[-1]))
        return PositionalShard(bounds, list(number), np.bincount(token, minlength=len(number)), np.argsort(token, kind="stable"))

    def stored(self) -> tuple[bytes, bytes, bytes, bytes]:
        """The shard as bytes; a list's positions as the first and the gaps."""
        gaps = np.diff(self.postings, prepend=0)
        first = self.begin[self.counts > 0]
        gaps[first] = self.postings[first]
        return self.bounds.astype("<i8").tobytes(), b" ".join(self.terms), self.counts.astype("<i4").tobytes(), gaps.astype("<i4").tobytes()

    @staticmethod
    def loaded(bounds: bytes, terms: bytes, counts: bytes, gaps: bytes) -> PositionalShard:
        n, jumps = np.frombuffer(counts, "<i4").astype(np.int64), np.frombuffer(gaps, "<i4").astype(np.int64)
        total, first = np.cumsum(jumps), np.cumsum(n) - n
        before = np.where(first > 0, total[first - 1], 0) if len(first) else first
        return PositionalShard(np.frombuffer(bounds, "<i8"), terms.split(b" ") if terms else [], n, total - np.repeat(before, n))

    def positions(self, term: bytes) -> np.ndarray:
        t = self.number.get(term)
        return self.postings[:0] if t is None else self.postings[self.begin[t] : self.begin[t] + self.counts[t]]

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, position, side="right") - 1

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each position is in its term's list."""
        wanted = term * (self.n + 1) + position
        return self.keys[np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)] == wanted

    def phrases(self, wanted: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence of every phrase: the phrase and its first position."""
        none, length = np.zeros(0, np.int64), wanted.length
        if not len(length) or not self.n:
            return none, none
        own = np.array([-1, *(self.number.get(w, -1) for w in wanted.vocabulary)], dtype=np.int64)  # by the phrases' term numbers
        inside = np.arange(wanted.terms.shape[1]) < length[:, None]
        live = np.flatnonzero(((own[wanted.terms] >= 0) | ~inside).all(axis=1))
        if not len(live):
            return none, none
        terms = own[wanted.terms[live]]
        frequency = np.where(inside[live], self.counts[terms], np.iinfo(np.int64).max)
        rarity = np.argsort(frequency, axis=1, kind="stable")
        rarest = terms[np.arange(len(live)), rarity[:, 0]]
        total = np.cumsum(self.counts[rarest])
        out_phrase, out_start = [none], [none]
        cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, int(total[-1]), CANDIDATES), side="left"), len(live)))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            n = self.counts[rarest[a:b]]
            row = np.repeat(np.arange(a, b), n)
            start = gather(self.postings, self.begin[rarest[a:b]], n) - rarity[row, 0]
            fits = (start >= 0) & (start + length[live[row]] <= self.n)
            row, start = row[fits], start[fits]
            for k in range(1, terms.shape[1]):
                if not len(row):
                    break
                offset = rarity[row, k]
                same = offset >= length[live[row]]  # a shorter phrase has no further term
                rest = np.flatnonzero(~same)
                same[rest] = self.holds(terms[row[rest], offset[rest]], start[rest] + offset[rest])
                row, start = row[same], start[same]
            whole = self.doc_of(start) == self.doc_of(start + length[live[row]] - 1)
            out_phrase.append(live[row[whole]])
            out_start.append(start[whole])
        return np.concatenate(out_phrase), np.concatenate(out_start)

    def near(self, terms: Sequence[bytes], slop: int) -> np.ndarray:
        """Positions of the rarest term with each other term within ``slop`` words in the same text."""
        lists = sorted((self.positions(t) for t in set(terms)), key=len)
        at = lists[0]
        for own in lists[1:]:
            if not len(own) or not len(at):
                return at[:0]
            after = np.searchsorted(own, at)
            ok = np.zeros(len(at), dtype=bool)
            for k in (after - 1, after):
                near = own[np.clip(k, 0, len(own) - 1)]
                ok |= (k >= 0) & (k < len(own)) & (np.abs(near - at) <= slop) & (self.doc_of(near) == self.doc_of(at))
            at = at[ok]
        return at


INDEX = "bounds binary, terms binary, counts binary, postings binary"


def build_index(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The index as a table in the shared folder: a row for each shard, with ``keep`` of its documents as the list ``docs``."""
    chosen = docs.select(F.col(text_col).alias("__text"), F.struct(*keep).alias("__keep"))
    kind = chosen.schema["__keep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices([t or "" for t in texts], SHARD):
                row = PositionalShard.of([words_of(t) for t in texts[a:b]]).stored()
                own = kept.slice(a, b - a)
                own = pa.StructArray.from_arrays([own.field(i) for i in range(own.type.num_fields)], fields=list(own.type))
                lists = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), own)
                yield pa.RecordBatch.from_arrays([lists, *(pa.array([x], pa.binary()) for x in row)], names=["docs", "bounds", "terms", "counts", "postings"])

    return written(chosen.mapInArrow(frugal(run), f"docs array<{kind}>, {INDEX}"), "index")


def parts_of(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark in parts of about PART characters, one after another on the driver; a shuffle deals it once."""
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    n = (rows.agg(F.sum(F.length("t"))).first()[0] or 0) // PART + 1
    if n == 1:
        yield [(r["i"], r["t"]) for r in rows.collect()]
        return
    dealt = written(rows.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(n))).repartitionByRange(min(n, 1000), "part"), "parts")
    for k in range(n):
        yield [(r["i"], r["t"]) for r in dealt.where(F.col("part") == k).collect()]


def judge(shard: PositionalShard, parts: Iterable[Phrases]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """For each text of a shard: its words, how many of them are hit, and the items found in it."""
    covered = np.zeros(shard.n + 1, dtype=np.int64)
    items: dict[int, set[str]] = {}
    for wanted in parts:
        phrase, start = shard.phrases(wanted)
        np.add.at(covered, start, 1)
        np.subtract.at(covered, start + wanted.length[phrase], 1)
        for d, p in zip(*np.unique(np.stack([shard.doc_of(start), phrase]), axis=1).tolist()):
            own = wanted.item[wanted.item_begin[p] : wanted.item_begin[p + 1]].tolist()
            items.setdefault(d, set()).update(map(wanted.names.__getitem__, own))
    hit = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return np.diff(shard.bounds), np.diff(hit[shard.bounds]), [sorted(items.get(d, ())) for d in range(len(shard.bounds) - 1)]


FOUND = "n_words long, n_hit long, n_items long, items array<string>, contaminated boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items (sorted array of item ids), contaminated.

    A word is hit if it lies inside an occurrence of a window of benchmark words.
    ``keep`` names further input columns to pass on.
    """
    context, names = docs.sparkSession.sparkContext, (id_col, *keep)
    index = build_index(docs, text_col, names)
    shipped = [context.broadcast(Phrases.windows(p, window)) for p in parts_of(benchmark, item_id, item_text)]

    def loaded() -> Iterator[Phrases]:
        for part in shipped:
            yield part.value
            if len(shipped) > 1:  # one part at a time in a worker's memory; it lies on the executor's disk
                part.__dict__.pop("_value", None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(0).slice(i, 1).flatten()
                n, hit, found = judge(PositionalShard.loaded(*(batch.column(c)[i].as_py() for c in range(1, 5))), loaded())
                made = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(hit > 0, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*own.flatten(), *made], names=[*names, "n_words", "n_hit", "n_items", "items", "contaminated"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return index.mapInArrow(frugal(run), f"{schema}, {FOUND}")


def search(docs: DataFrame, queries: Sequence[tuple[str, str]], slop: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matches of (query id, words): exact phrases, or with ``slop`` all words within that many words of the rarest.

    One row per match: document, query, position in words of the phrase (or of the rarest word).
    """
    index = build_index(docs, text_col, (id_col,))
    listed = [(q, ws) for q, t in queries if (ws := words_of(t))]
    vocabulary: dict[bytes, int] = {}
    numbered = [tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws) for _, ws in listed]
    longest = max(map(len, numbered), default=1)
    phrases = Phrases(vocabulary, np.array([p + (0,) * (longest - len(p)) for p in numbered], dtype=np.int32).reshape(len(numbered), longest), np.array([len(p) for p in numbered], dtype=np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0).slice(i, 1).flatten().field(0)
                shard = PositionalShard.loaded(*(batch.column(c)[i].as_py() for c in range(1, 5)))
                if slop is None:
                    which, at = shard.phrases(phrases)
                else:
                    each = [shard.near(ws, slop) for _, ws in listed]
                    which, at = np.repeat(np.arange(len(each)), [len(x) for x in each]), np.concatenate([*each, np.zeros(0, np.int64)]).astype(np.int64)
                doc = shard.doc_of(at)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array([listed[i][0] for i in which.tolist()], pa.string()), pa.array(at - shard.bounds[doc], pa.int64())], names=[id_col, "query_id", "position"])

    return index.mapInArrow(frugal(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, query_id string, position long")
