"""Pre-token boundaries of GPT-style split patterns, found with numpy over whole buffers.

Each code point has a class (letter, number, space, other); the boundaries that
the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
draws depend on class changes, single spaces before a run, and apostrophes that
stand alone before certain letters; so no regular expression runs per match.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


@functools.cache
def class_table() -> np.ndarray:
    """The class of every code point, by Unicode's general category and White_Space."""
    import regex

    every = np.arange(0x110000, dtype="<u4")
    every = np.delete(every, np.s_[0xD800:0xE000])
    text = every.tobytes().decode("utf-32-le")
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, text):
            table[every[m.start() : m.end()]] = kind
    return table


@functools.cache
def disputed() -> np.ndarray:
    """Code points whose class two Unicode versions tell differently; for these a library must be asked."""
    import unicodedata

    table = class_table()
    high = np.flatnonzero(table != OTHER)
    major = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in high.tolist()], dtype=np.uint8)
    return high[(major != table[high]) & (table[high] != SPACE)]


def joined(texts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts one after another, their code points, and the start of each text (and the end)."""
    text = "".join(texts)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), out=ends[1:])
    return text, codes, ends


def _runs(codes: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, whether a run of one class starts, and whether a text starts, at each position (and one past the end)."""
    n = len(codes)
    kind = np.empty(n + 1, dtype=np.uint8)
    np.take(classes, codes, out=kind[:n])
    kind[n] = 255
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[bounds] = True
    start = fresh.copy()
    start[1:] |= kind[1:] != kind[:-1]
    return kind, start, fresh


def _contractions(codes: np.ndarray, kind: np.ndarray, start: np.ndarray, fresh: np.ndarray) -> None:
    """Joins a lone apostrophe with s, t, m, d, re, ve or ll after it, and parts what follows."""
    n = len(codes)
    at = np.flatnonzero(codes == 0x27)
    at = at[at + 1 < n]
    at = at[start[at] & start[at + 1] & ~fresh[at + 1] & (kind[at + 1] == LETTER)]
    for p in at.tolist():
        first = int(codes[p + 1])
        if first in (0x73, 0x74, 0x6D, 0x64):
            start[p + 1], start[p + 2] = False, True
        elif p + 2 < n and not fresh[p + 2] and (first, int(codes[p + 2])) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)):
            start[p + 1], start[p + 3] = False, True


def spaced_pieces(codes: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens when a run keeps one space before it; every character lies in one."""
    kind, start, fresh = _runs(codes, bounds, classes)
    after = np.flatnonzero((kind[1:-1] != SPACE) & (kind[:-2] == SPACE) & ~fresh[1:-1]) + 1 if len(codes) > 1 else np.zeros(0, np.int64)
    start[after - 1] = True
    start[after] = codes[after - 1] != 0x20
    _contractions(codes, kind, start, fresh)
    return np.flatnonzero(start[:-1])


def bare_pieces(codes: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pre-tokens when each number stands alone, and which of them are no white space."""
    kind, start, fresh = _runs(codes, bounds, classes)
    start |= kind == NUMBER
    _contractions(codes, kind, start, fresh)
    starts = np.flatnonzero(start[:-1])
    return starts, kind[starts] != SPACE


def gather(table: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """table[begin[0]:begin[0]+length[0]], table[begin[1]:...], ... end to end."""
    total = int(length.sum())
    if not total:
        return table[:0]
    kind = np.int32 if max(total, len(table)) < 2**31 else np.int64
    ends = np.cumsum(length)
    index = np.arange(total, dtype=kind)
    index += np.repeat((begin - (ends - length)).astype(kind), length)
    return table[index]


def slices(texts: Sequence[str], chars: int) -> list[tuple[int, int]]:
    """Ranges of texts of about so many characters together; a longer text is alone."""
    out, begin, held = [], 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > chars:
            out.append((begin, i))
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out


_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64, i < n, for an odd P; one table of the greatest n so far is kept."""
    if n > len(_POWERS[0]):
        size, base = 1 << (n - 1).bit_length(), 0x9E3779B97F4A7C15
        for i, x in enumerate((base, pow(base, -1, 2**64))):
            table = np.full(size, x, dtype=np.uint64)
            table[0] = 1
            _POWERS[i] = np.multiply.accumulate(table)
    return _POWERS[0][:n], _POWERS[1][:n]


@functools.cache
def _letters() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def distinct(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index of each different byte string, and for every string which of these it equals.

    Strings are told apart by a 64-bit polynomial hash and length; the bytes are compared afterwards,
    and should two strings ever share a hash, they are told apart by their bytes.
    """
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = _powers(max(4096, len(data) + 1))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_letters()[data] * up[: len(data)], out=total[1:])
    mark = (total[begin + length] - total[begin]) * down[begin] + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    which, kinds = pd.factorize(mark)
    one = np.zeros(len(kinds), dtype=np.int64)
    one[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    if not _same(data, begin, length, one[which]):
        raw, seen = data.tobytes(), {}
        which = np.array([seen.setdefault(raw[b : b + n], len(seen)) for b, n in zip(begin.tolist(), length.tolist(), strict=True)])
        _, one = np.unique(which, return_index=True)
    return one, which


def _same(data: np.ndarray, begin: np.ndarray, length: np.ndarray, other: np.ndarray) -> bool:
    """Whether each string has the bytes of the other: the first and last eight for all, every byte for those of over 16."""
    if not np.array_equal(length, length[other]):
        return False
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))
    spare = (8 * (8 - np.minimum(length, 8))).astype(np.uint64)
    spare[length == 0] = 0
    head = eight[begin + 8] << spare
    tail = eight[begin + length] >> spare
    empty = length == 0
    head[empty] = tail[empty] = 0
    if not np.array_equal(head, head[other]) or not np.array_equal(tail, tail[other]):
        return False
    long = np.flatnonzero(length > 16)
    return np.array_equal(gather(data, begin[long], length[long]), gather(data, begin[other[long]], length[long]))


class Words:
    """The pre-tokens of some texts as distinct byte strings."""

    def __init__(self, texts: Sequence[str], bare: bool = False, classes: np.ndarray | None = None):
        classes = class_table() if classes is None else classes
        text, codes, bounds = joined(texts)
        raw = text.encode("utf-8", "replace")
        starts, keep = bare_pieces(codes, bounds, classes) if bare else (spaced_pieces(codes, bounds, classes), None)
        self.first = np.searchsorted(starts, bounds)  # of each text, and one past the last
        begin = starts
        if len(raw) != len(text):
            wide = np.zeros(len(codes) + 1, dtype=np.int64)
            np.cumsum(1 + (codes > 0x7F).view(np.int8) + (codes > 0x7FF).view(np.int8) + (codes > 0xFFFF).view(np.int8), out=wide[1:])
            begin = wide[starts]
        length = np.diff(begin, append=len(raw))
        if keep is not None:
            self.first = np.concatenate([[0], np.cumsum(keep)])[self.first]
            begin, length = begin[keep], length[keep]
        data = np.frombuffer(raw or b"\0", dtype=np.uint8)
        self.begin, self.end = begin, begin + length  # in bytes of all texts
        one, self.which = distinct(data, begin, length)
        self.words = [raw[b : b + n] for b, n in zip(begin[one].tolist(), length[one].tolist(), strict=True)]


class Arena:
    """The ids of known words, end to end."""

    def __init__(self):
        self.row: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.place = np.zeros((1 << 12, 2), dtype=np.int64)

    def add(self, words: Sequence[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        n, row = len(ids), len(self.row)
        if self.used + n > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + n))
        if row + len(words) > len(self.place):
            self.place = np.resize(self.place, (2 * (row + len(words)), 2))
        self.ids[self.used : self.used + n] = ids
        self.place[row : row + len(words), 0] = self.used + np.cumsum(counts) - counts
        self.place[row : row + len(words), 1] = counts
        self.row.update(zip(words, range(row, row + len(words)), strict=True))
        self.used += n

    def expand(self, part: Words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a part end to end, and where each text begins (and the end)."""
        rows = np.fromiter(map(self.row.__getitem__, part.words), dtype=np.int64, count=len(part.words))
        where = self.place[rows][part.which]
        ends = np.zeros(len(where) + 1, dtype=np.int64)
        np.cumsum(where[:, 1], out=ends[1:])
        return gather(self.ids, where[:, 0], where[:, 1]), ends[part.first]
