"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is merged pair by pair in rank order. Waiting pairs lie in one
bucket per merge rank; a bitmap tree over the ranks gives the lowest non-empty
bucket by find-first-set, each bucket yields its leftmost position, and entries
whose pair has changed meanwhile are stale and skipped. The cost of a pre-token
of n bytes is O(n log n), whatever its length.

Defined results: a null text is encoded like an empty one (no ids). Repeated
rows give repeated rows; an empty table an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal
from .pretoken import LETTER, NUMBER, OTHER, Arena, Words, class_table, disputed, gather, slices

#: Pre-tokens whose ids a worker keeps between batches and tasks; the table starts anew beyond it. It bounds memory only.
MEMO = 200_000
#: Characters of the texts that are encoded together, and of those that numpy works on at once.
BLOCK, RUN = 3_000_000, 1_200_000


class RankQueue:
    """Buckets of positions by rank, under a tree of 64-bit words that marks the non-empty ones."""

    def __init__(self, n_ranks: int):
        self.levels: list[list[int]] = []
        size = max(1, n_ranks)
        while True:
            size = (size + 63) // 64
            self.levels.append([0] * size)
            if size == 1:
                break
        self.down = self.levels[::-1]
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        for words in self.levels:
            bit = 1 << (rank & 63)
            rank >>= 6
            if words[rank]:
                words[rank] |= bit
                return
            words[rank] = bit

    def first(self) -> int:
        """The lowest rank that waits; -1 if none does."""
        at = 0
        for words in self.down:
            word = words[at]
            if not word:
                return -1
            at = (at << 6) | ((word & -word).bit_length() - 1)
        return at

    def take(self, rank: int) -> list[int]:
        """All positions of a rank, whose bucket is unmarked up the tree."""
        bucket = self.buckets.pop(rank)
        for words in self.levels:
            bit = 1 << (rank & 63)
            rank >>= 6
            words[rank] ^= bit
            if words[rank]:
                break
        return bucket


@functools.cache
def library_classes() -> np.ndarray:
    """Classes of code points as the tiktoken library's split sees them.

    Only code points that Unicode versions dispute are asked for: a string is one
    token of a small vocabulary of whole strings exactly if it is one pre-token.
    """
    import public_tokenizers
    import tiktoken

    table, doubtful = class_table().copy(), disputed().tolist()
    probes = {f"{lead}{chr(c)}": (kind, c) for c in doubtful for lead, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER))}
    ranks = {bytes([i]): i for i in range(256)} | {x.encode("utf-8"): 256 + i for i, x in enumerate(probes)}
    own = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text, (kind, c) in probes.items():
        if len(own.encode_ordinary(text)) == 1:
            table[c] = kind
    return table


class ByteBpe:
    """Encoder and decoder for one table of ranks; the id of a token is its rank.

    The pre-tokens are those of ``pretoken.spaced_pieces``. A block of texts is
    encoded together: its distinct new pre-tokens lie side by side in one array
    with barriers between them, and one queue merges them all, a whole bucket at
    a time.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                x, y = ranks.get(token[:i]), ranks.get(token[i:])
                if x is not None and y is not None:
                    pairs[x * self.size + y] = rank
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_keys = np.append(keys, np.int64(2**62))
        self.pair_ranks = np.array([*map(pairs.__getitem__, keys.tolist()), -1], dtype=np.int64)
        self.tokens, self.decimal = Table(tokens, 16), Table([b"%d " % i for i in range(self.size)], 8)
        self.queue, self.arena = RankQueue(self.size), Arena()

    def rank_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank that the two parts have as one token; -1 if none, or if either is no part."""
        key = x * self.size + y
        at = np.searchsorted(self.pair_keys, key)
        return np.where((self.pair_keys[at] == key) & (x >= 0) & (y >= 0), self.pair_ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens end to end, and how many each has.

        Within a bucket the leftmost pair goes first. Pairs that don't touch don't
        affect each other; a bucket goes at once unless one of its merges would
        make a pair of the same rank or a lower one, when they go one by one.
        """
        whole = [self.ranks.get(x, -1) for x in pieces]
        long = b"".join(x for x, w in zip(pieces, whole, strict=True) if w < 0)
        sizes = np.array([len(x) if w < 0 else 1 for x, w in zip(pieces, whole, strict=True)], dtype=np.int64)
        ends = np.cumsum(sizes + 1)  # a barrier of -1 follows each
        n = int(ends[-1]) if len(pieces) else 0
        part = np.full(n + 1, -1, dtype=np.int64)
        inside = np.ones(n, dtype=bool)
        inside[ends - 1] = False
        known = np.array(whole, dtype=np.int64)
        values = np.repeat(known, sizes)
        values[values < 0] = self.single[np.frombuffer(long, dtype=np.uint8)]
        if len(values) and values.min() < 0:
            raise ValueError("the vocabulary lacks some single bytes")
        part[:n][inside] = values
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        pair = np.full(n + 1, -1, dtype=np.int64)
        pair[:-1] = self.rank_of(part[:-1], part[1:])
        queue = self.queue
        order = np.argsort(pair, kind="stable")
        order = order[np.searchsorted(pair[order], 0) :]
        found, begin = np.unique(pair[order], return_index=True)
        for rank, own in zip(found.tolist(), np.split(order, begin[1:]), strict=False):
            queue.push(rank, own.tolist())
        while (rank := queue.first()) >= 0:
            taken = np.array(queue.take(rank))
            at = taken[pair[taken] == rank]  # the others are stale
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
            waiting, middle = at, after[at]
            if (pair[middle] == rank).any():  # pairs that share a part
                free, kept = -1, []
                for i, j in zip(at.tolist(), middle.tolist(), strict=True):
                    if i >= free:
                        kept.append(i)
                        free = int(after[j])
                at = np.array(kept)
                middle = after[at]
            right, left = after[middle], before[at]
            new = self.rank_of(np.concatenate([np.full(len(at), rank), np.where(left >= 0, part[left], -1)]), np.concatenate([part[right], np.full(len(at), rank)]))
            if ((new >= 0) & (new <= rank)).any() and len(waiting) > 1:
                queue.push(rank, waiting[1:].tolist())
                at, middle, right = at[:1], middle[:1], right[:1]
            part[at] = rank
            after[at] = right
            before[right] = at
            part[middle] = -2
            pair[middle] = -1
            left = before[at]
            left = left[left >= 0]
            touched = np.concatenate([at, left])
            new = self.rank_of(part[touched], part[after[touched]])
            pair[touched] = new
            for r, i in zip(new.tolist(), touched.tolist(), strict=True):
                if r >= 0:
                    queue.push(r, [i])
        alive = part[:n] != -2
        ids = part[:n][alive]
        counts = np.diff(np.concatenate([[0], np.flatnonzero(ids == -1) + 1])) - 1
        return ids[ids >= 0], counts

    def encode_block(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each run of texts: the first text's index, the ids end to end, where each text begins (and the end)."""
        texts = [t or "" for t in texts]
        if len(self.arena.row) > MEMO:
            self.arena = Arena()
        parts = [(a, Words(texts[a:b], classes=library_classes())) for a, b in slices(texts, RUN)]
        new = [w for w in dict.fromkeys(chain.from_iterable(p.words for _, p in parts)) if w not in self.arena.row]
        if new:
            self.arena.add(new, *self.merge(new))
        for a, part in parts:
            yield a, *self.arena.expand(part)

    def encode(self, text: str | None) -> list[int]:
        return next((ids.tolist() for _, ids, _ in self.encode_block([text])), [])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each text's ids."""
        return self.tokens.joined(ids, bounds)

    def decimals(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Each text's ids in decimal, joined by one space."""
        return [x[:-1] for x in self.decimal.joined(ids, bounds)]


class Table:
    """Byte strings by id: padded rows for those of up to ``width`` bytes, packed for all."""

    def __init__(self, parts: list[bytes], width: int):
        self.length = np.array([len(x) for x in parts], dtype=np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.packed = np.frombuffer(b"".join(parts) or b"\0", dtype=np.uint8)
        self.width = width
        self.rows = np.frombuffer(b"".join(x[:width].ljust(width, b"\0") for x in parts), dtype=np.uint8).reshape(-1, width)
        self.filled = np.arange(width) < self.length[:, None]

    def joined(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """For each text, the entries of its ids, end to end."""
        sizes = self.length[ids]
        if len(ids) and sizes.max() > self.width:
            data = gather(self.packed, self.begin[ids], sizes).tobytes()
        else:
            data = self.rows[ids][self.filled[ids]].tobytes()
        ends = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(sizes, out=ends[1:])
        at = ends[bounds].tolist()
        return [data[a:b] for a, b in zip(at, at[1:])]


def read_ranks(path: str) -> dict[bytes, int]:
    """A table of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


@functools.cache
def loaded(path: str) -> ByteBpe:
    """The encoder of a file, read once in each worker."""
    return ByteBpe(read_ranks(path))


def default_vocabulary() -> str:
    """Path of the installed 50k byte-level vocabulary, whose pattern is the built-in splitting."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of whole texts; narrow, no shuffle."""
    path = path or default_vocabulary()

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(path)
        for texts in batches:
            out, texts = [], [t or "" for t in texts]
            for a, b in slices(texts, BLOCK):
                for _, got, at in bpe.encode_block(texts[a:b]):
                    out += np.split(got, at[1:-1])
            made = pd.Series([None] * len(out), dtype=object)
            made[:] = out
            yield made

    return docs.select(F.col(id_col), ids(F.col(text_col)).alias("ids"))


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, decoded binary) from ids; a null array gives no bytes."""
    path = path or default_vocabulary()

    @F.pandas_udf("binary")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(path)
        for rows in batches:
            yield pd.Series([b"" if ids is None else bpe.decode(np.asarray(ids, dtype=np.int64), np.array([0, len(ids)]))[0] for ids in rows], dtype=object)

    return encoded.select(F.col(id_col), back(F.col(ids_col)).alias("decoded"))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """Encodes and decodes each text in one pass; narrow, no shuffle.

    Adds n_tokens, ids_sha256, decoded_sha256 and exact (the decoded bytes are
    the text's). ``keep`` names further input columns to pass on.
    """
    path = path or default_vocabulary()

    def worked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for texts in batches:
            rows, texts = [], [t or "" for t in texts]
            for a, b in slices(texts, BLOCK):
                for i, ids, at in bpe.encode_block(texts[a:b]):
                    for text, n, ids_text, data in zip(texts[a + i : b], np.diff(at).tolist(), bpe.decimals(ids, at), bpe.decode(ids, at), strict=False):
                        rows.append((n, hashlib.sha256(ids_text).hexdigest(), hashlib.sha256(data).hexdigest(), data == text.encode("utf-8")))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from frugal(worked)(batches)

    made = docs.select(F.col(id_col), *keep, both(F.col(text_col)).alias("made"))
    return made.select(id_col, *keep, "made.*")
