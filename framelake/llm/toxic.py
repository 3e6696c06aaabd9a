"""Toxicity scores from a learned lexicon, misspellings included, with context windows.

A lexicon of telling words is learned from labelled texts. Its words form a trie;
a text's word becomes a Levenshtein automaton (bit-parallel, one state set for
each number of edits) that is run along the trie, so all lexicon words within
the allowed edits are met in one walk that leaves dead branches at once. Edits are
of letters, whatever their bytes (words of few letters but enough bytes are met by
bytes). Two runs of letters with one digit or symbol between them are also looked
up as one word, unless a run is a match of its own. Around
each match a window of words tells quotation (quote marks on both sides, or words
of reporting) from abuse. A logistic regression on a few sums of matches gives
the score.

The model is fitted on at most ``LABELLED`` labelled rows, chosen by a hash of the
id. A word counts once for each different word before it, so copies of one text
do not make its words telling. Everything is learned from rows outside the
held-out fold; labels, languages, sources and ids are no inputs of a score.

Defined results: a null or empty text is scored like one without matches. If
there are no labels, every score is 0. Several labels of one id: toxic if any is.
Repeated rows give repeated rows; an empty table an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, frugal, written
from .pretoken import Words, slices

#: Labelled rows that the model is fitted on; the least evidence (G squared) and precision of a word.
LABELLED, EVIDENCE, PRECISION = 8000, 22.0, 0.7
#: Edits allowed in words of at least so many letters or bytes; words on either side of a match that are looked at.
EDITS, LEAST_LENGTH, WINDOW = 1, 5, 6
#: Characters worked on at once, and words remembered. They bound memory only.
RUN, MEMO = 1_200_000, 250_000

#: What is remembered of a word that is near no lexicon word.
MISS = (-1, 0)

# Marks and words that show quotation or report, lower case.
QUOTES = '" “ ” „ « » ‹ › ‘ ’ \' `'
REPORTING = """
said says quote quoted quotes called term word wrote reported
sagte sagt zitat zitierte nannte wort schrieb
dit disait citation cité mot écrit appelé
dijo dice cita citó palabra escribió llamó
"""


class Trie:
    """Lexicon words by their letters or bytes; a node is (children, index of the word that ends here or -1)."""

    def __init__(self, words: Sequence[str] | Sequence[bytes]):
        self.root: list = [{}, -1]
        for i, w in enumerate(words):
            node = self.root
            for c in w:
                node = node[0].setdefault(c, [{}, -1])
            node[1] = i


class Levenshtein:
    """The automaton of all strings (of letters or of bytes) within ``edits`` edits of a word.

    State e is a set of places in the word, as bits: bit i is set if the first i
    letters can be matched with e edits.
    """

    def __init__(self, word: str | bytes, edits: int):
        self.size, self.edits = len(word), edits
        self.match: dict[int | str, int] = {}
        for i, c in enumerate(word):
            self.match[c] = self.match.get(c, 0) | (1 << i)
        self.full = (1 << (len(word) + 1)) - 1

    def start(self) -> tuple[int, ...]:
        return tuple((1 << (e + 1)) - 1 & self.full for e in range(self.edits + 1))

    def step(self, states: tuple[int, ...], c: int | str) -> tuple[int, ...]:
        hit = self.match.get(c, 0)
        out = [(states[0] & hit) << 1]
        for e in range(1, len(states)):
            before = states[e - 1]
            out.append((((states[e] & hit) | before | out[e - 1]) << 1 | before) & self.full)
        return tuple(out)

    def edits_used(self, states: tuple[int, ...]) -> int:
        """The least edits with which the whole word is matched; -1 if it isn't."""
        return next((e for e, s in enumerate(states) if s >> self.size & 1), -1)

    def along(self, trie: Trie) -> Iterator[tuple[int, int]]:
        """(word index, edits) of every lexicon word that the automaton accepts."""
        stack = [(trie.root, self.start())]
        while stack:
            (children, end), states = stack.pop()
            if end >= 0 and (used := self.edits_used(states)) >= 0:
                yield end, used
            for c, child in children.items():
                if any(after := self.step(states, c)):
                    stack.append((child, after))


class Near:
    """The lexicon words, all of letters or all of bytes, that may be met with edits."""

    def __init__(self, words: Sequence[str] | Sequence[bytes], number: Sequence[int]):
        self.number, self.trie = number, Trie(words)
        # one edit leaves the first or the last half of a word as it is
        self.heads, self.tails = {w[: len(w) // 2] for w in words}, {w[len(w) // 2 :] for w in words}
        self.head_sizes, self.tail_sizes = sorted({len(h) for h in self.heads}), sorted({len(t) for t in self.tails})
        self.longest = max(map(len, words), default=-EDITS)

    def look_up(self, word: str | bytes) -> tuple[int, int] | None:
        """(edits, lexicon index) of the nearest word."""
        n = len(word)
        if not LEAST_LENGTH - EDITS <= n <= self.longest + EDITS:
            return None
        if EDITS == 1 and not any(word[:h] in self.heads for h in self.head_sizes) and not any(word[n - t :] in self.tails for t in self.tail_sizes if t <= n):
            return None
        return min(((used, self.number[i]) for i, used in Levenshtein(word, EDITS).along(self.trie)), default=None)


class Matcher:
    """The lexicon's word that a text's word means, if any; what was found is remembered."""

    def __init__(self, words: Sequence[str], weights: Sequence[float]):
        self.words = [w.encode("utf-8") for w in words]
        self.weight = np.array([*weights, 0.0])
        self.exact = {w: i for i, w in enumerate(self.words)}
        long = [i for i, w in enumerate(words) if len(w) >= LEAST_LENGTH]
        wide = [i for i, w in enumerate(words) if len(w) < LEAST_LENGTH <= len(self.words[i])]
        self.letters, self.bytes = Near([words[i] for i in long], long), Near([self.words[i] for i in wide], wide)
        self.marks = {q.encode("utf-8") for q in QUOTES.split()}
        self.reporting = {w.encode("utf-8") for w in REPORTING.split()}
        self.memo: dict[bytes, tuple[int, int]] = {}

    def look_up(self, word: bytes) -> tuple[int, int]:
        """(lexicon index or -1, edits)."""
        if (i := self.exact.get(word)) is not None:
            return i, 0
        found = min(filter(None, (self.letters.look_up(word.decode("utf-8", "replace")), self.bytes.look_up(word))), default=None)
        return MISS if found is None else (found[1], found[0])

    def remembered(self, word: bytes) -> tuple[int, int]:
        hit = self.memo.get(word)
        if hit is None:
            hit = self.memo[word] = self.look_up(word)
        return hit

    def broken(self, part: Words, missed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a word begins that one digit or symbol breaks, and its lexicon word; ``missed`` tells which pieces are no match.

        Lexicon words are of letters alone, so one edit mends no more than one such
        character; at an end of a word, the letters alone are one edit away.
        """
        n = len(part.which) - 2
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        plain = [w.decode("utf-8", "replace") for w in part.words]
        letters = np.fromiter((w.isalpha() for w in plain), dtype=bool, count=len(plain))[part.which]
        single = np.fromiter((len(w) == 1 and not w.isalpha() for w in plain), dtype=bool, count=len(plain))[part.which]
        touch = part.end[:-1] == part.begin[1:]
        touch[part.first[(part.first > 0) & (part.first < len(part.which))] - 1] = False
        sides = letters & missed
        at = np.flatnonzero(sides[:n] & single[1:-1] & sides[2:] & touch[:-1] & touch[1:])
        words = [part.words[a] + part.words[b] + part.words[c] for a, b, c in zip(*(part.which[at + k].tolist() for k in range(3)), strict=True)]
        index = np.array([self.remembered(w)[0] for w in words], dtype=np.int64)
        return at[index >= 0], index[index >= 0]

    def features(self, texts: Sequence[str | None]) -> np.ndarray:
        """One row per text: sums over matches, by kind."""
        out = np.zeros((len(texts), N_FEATURES))
        texts = [(t or "").lower() for t in texts]
        for a, b in slices(texts, RUN):
            part = Words(texts[a:b], bare=True)
            if len(self.memo) > MEMO:
                self.memo.clear()
            found = [self.remembered(w) for w in part.words]
            index = np.array([i for i, _ in found], dtype=np.int64)
            edits = np.array([e for _, e in found], dtype=np.int64)
            mark = np.fromiter((bool(self.marks.intersection((w, w[:1], w[-1:], w[-3:], w[:3], w[:2], w[-2:]))) for w in part.words), dtype=bool, count=len(part.words))
            report = np.fromiter(map(self.reporting.__contains__, part.words), dtype=bool, count=len(part.words))
            at = np.flatnonzero(index[part.which] >= 0) if len(part.which) else np.zeros(0, np.int64)
            hits, exact = index[part.which[at]], edits[part.which[at]] == 0
            mended, meant = self.broken(part, index[part.which] < 0)
            after = np.concatenate([at + 1, mended + 3])
            at, hits, exact = np.concatenate([at, mended]), np.concatenate([hits, meant]), np.concatenate([exact, np.zeros(len(mended), dtype=bool)])
            first = part.first
            doc = np.searchsorted(first, at, side="right") - 1
            lo, hi = np.maximum(at - WINDOW, first[doc]), np.minimum(after + WINDOW, first[doc + 1])
            marks = np.concatenate([[0], np.cumsum(mark[part.which])]) if len(part.which) else np.zeros(1, np.int64)
            reports = np.concatenate([[0], np.cumsum(report[part.which])]) if len(part.which) else np.zeros(1, np.int64)
            quoted = ((marks[at] > marks[lo]) & (marks[hi] > marks[np.minimum(after, hi)])) | (reports[hi] > reports[lo])
            weight = self.weight[hits]
            for column, chosen in enumerate((exact & ~quoted, ~exact & ~quoted, quoted)):
                np.add.at(out[a:b, column], doc[chosen], weight[chosen])
            pairs = np.unique(np.stack([doc[~quoted], hits[~quoted]]), axis=1)
            np.add.at(out[a:b, 3], pairs[0], 1.0)
            out[a:b, 4] = out[a:b, 0] / np.maximum(np.diff(first), 20) * 100.0
        return np.log1p(out)


N_FEATURES = 5


@dataclass(frozen=True)
class Model:
    words: tuple[str, ...]
    weights: tuple[float, ...]
    coefficients: np.ndarray  # the last is the bias

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.coefficients[:-1] + self.coefficients[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled texts outside the held-out fold: (text, toxic).

    The chosen labels (16 bytes each) are broadcast, so no text is shuffled.
    """
    rows = labels.where((fold_of(id_col) != 0) & F.col("toxic").isNotNull()).groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = rows.orderBy(F.xxhash64(id_col), id_col).limit(limit)
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), id_col).select("text", "toxic")


def lexicon(sample: DataFrame) -> list[tuple[str, float]]:
    """Words that toxic texts use far more than others, with log odds: all that the bounded sample tells."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    pairs = sample.withColumn("w", words).select("toxic", F.explode(F.arrays_zip(F.col("w").alias("word"), F.concat(F.array(F.lit("")), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))).alias("before"))).alias("x"))
    pairs = pairs.select("toxic", F.col("x.word").alias("word"), F.col("x.before").alias("before")).where("word IS NOT NULL")
    units = pairs.groupBy("word", "before").agg(F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("n"))
    counts = units.groupBy("word").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    counts = written(counts, "words")
    total = counts.agg(F.sum("t").alias("t"), F.sum("n").alias("n")).first()
    if not total["t"] or not total["n"]:
        return []
    t, n = F.col("t").cast("double"), F.col("n").cast("double")
    share = total["t"] / (total["t"] + total["n"])
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    evidence = 2 * (part(t, (t + n) * share) + part(n, (t + n) * (1 - share)))
    odds = F.log(((t + 0.5) / (total["t"] + 1)) / ((n + 0.5) / (total["n"] + 1)))
    told = counts.select("word", evidence.alias("g"), odds.alias("odds"), (t / (t + n)).alias("precision")).where((F.col("g") >= EVIDENCE) & (F.col("odds") > 0) & (F.col("precision") >= PRECISION))
    return [(r["word"], r["odds"]) for r in told.orderBy(F.desc("g"), "word").collect()]


def fit(features: np.ndarray, label: np.ndarray, decay: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton's method; the bias is not decayed."""
    x = np.hstack([features, np.ones((len(features), 1))])
    penalty = np.full(x.shape[1], decay * len(x))
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - label) + penalty * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LABELLED) -> Model:
    """A model from the bounded sample; the driver gets the lexicon and five numbers for each sampled row."""
    sample = written(sample_of(docs, labels, id_col, text_col, limit), "labelled")
    words = lexicon(sample)
    names, weights = tuple(w for w, _ in words), tuple(o for _, o in words)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(names, weights)
        for batch in batches:
            out = pd.DataFrame(matcher.features(batch["text"].tolist()), columns=[f"f{i}" for i in range(N_FEATURES)])
            yield out.assign(toxic=batch["toxic"].astype("float64").to_numpy())

    columns = [f"f{i}" for i in range(N_FEATURES)]
    rows = np.array([tuple(r) for r in sample.mapInPandas(measure, ", ".join(f"{c} double" for c in [*columns, "toxic"])).collect()], dtype=np.float64).reshape(-1, N_FEATURES + 1)
    if not len(rows) or rows[:, -1].max() < 1:
        return Model(names, weights, np.append(np.zeros(N_FEATURES), -math.inf))
    rows = rows[np.lexsort(rows.T)]  # the same rows in any order give the same sums
    return Model(names, weights, fit(rows[:, :-1], rows[:, -1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every row; narrow."""

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(model.words, model.weights)
        for texts in batches:
            features = matcher.features(texts.tolist())
            yield pd.Series(model.scores(features) if np.isfinite(model.coefficients).all() else np.zeros(len(features)))

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from frugal(judged)(batches)

    scored = docs.select(F.col(id_col), (fold_of(id_col) == 0).alias("held_out"), judge(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
