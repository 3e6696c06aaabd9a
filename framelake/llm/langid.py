"""Language identification with hyperdimensional n-gram profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds its
letters' vectors, each permuted (rotated) by its place; a document's profile and
a language's prototype bundle (add up) the vectors of their n-grams. The
language whose prototype has the highest cosine with the document wins.

All sums are of integers, so neither order nor partitioning changes a result.

A text is rejected if it has no language, or if its cosine is less than texts of
its length have with their own language: a share (``SLACK``) of a low quantile
(``LOW``) over all training rows of the language and length class. With fewer
than ``LEAST_ROWS`` training rows the class of all languages counts, then the next
shorter class; without one nothing but ``und`` is rejected.

Defined results: ``und`` with score 0 if a text is null or has no letter, or if
nothing was learned. Ties go to the first language in string order. Repeated
rows give repeated rows; an empty table an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, frugal
from .pretoken import LETTER, class_table, joined, slices

DIMENSIONS, ORDER, SEED = 512, 3, 7
#: Characters worked on at once; cells of a count matrix; n-grams bound at once. They bound memory only.
RUN, CELLS, BOUND = 1_000_000, 4_000_000, 4096
BITS = 21  # of a code point
#: The quantile of the training rows' own cosines, the share of it that is asked for, and the rows that a class needs.
LOW, SLACK, LEAST_ROWS = 0.001, 0.8, 50
#: Upper bounds (exclusive) of the classes by number of n-grams; the last class is open.
LENGTHS = (4, 16, 64, 256, 1024)


class Binder:
    """Vectors of letters and n-grams."""

    def __init__(self, dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = SEED):
        if order * BITS > 63:
            raise ValueError("n-grams of at most three letters fit a number")
        self.dimensions, self.order, self.seed = dimensions, order, seed
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.default_rng((self.seed, code)).integers(0, 2, self.dimensions)
            self.letters[code] = (2 * bits - 1).astype(np.float32)
        return self.letters[code]

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """One row per n-gram: the product of its letters' vectors, the first rotated most."""
        out = np.ones((len(grams), self.dimensions), dtype=np.float32)
        for place in range(self.order):
            codes, which = np.unique((grams >> (BITS * place)) & ((1 << BITS) - 1), return_inverse=True)
            own = np.array([np.roll(self.letter(c), place) for c in codes.tolist()], dtype=np.float32).reshape(-1, self.dimensions)
            out *= own[which]
        return out

    def grams(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each n-gram within the words of the texts (a space before and after), and its text's index."""
        _, codes, bounds = joined([f"\n{t.lower()}\n" for t in texts])
        letter = class_table()[codes] == LETTER
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[bounds[:-1]] = True
        code = np.where(letter, codes, 32)[keep].astype(np.int64)
        text = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(bounds))[keep]
        n = len(code) - self.order + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        gram, inside = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for i in range(self.order):
            gram = (gram << BITS) | code[i : n + i]
            if 0 < i < self.order - 1:
                inside &= code[i : n + i] != 32
        inside &= text[:n] == text[self.order - 1 :]
        return gram[inside], text[:n][inside]

    def bundle(self, texts: Sequence[str], group: np.ndarray | None = None, n_groups: int | None = None) -> np.ndarray:
        """The profile of each text, or of each group of texts."""
        return self.bundled(*self.grams(texts), len(texts) if n_groups is None else n_groups, group)

    def bundled(self, gram: np.ndarray, text: np.ndarray, n: int, group: np.ndarray | None = None) -> np.ndarray:
        """The same from the n-grams and their texts' indexes."""
        row = text if group is None else group[text]
        out = np.zeros((n, self.dimensions), dtype=np.float64)
        which, kinds = pd.factorize(gram)
        order = np.argsort(row, kind="stable") if group is not None else None
        if order is not None:
            row, which = row[order], which[order]
        step = max(1, CELLS // max(1, len(kinds)))
        for a in range(0, n, step):
            b = min(n, a + step)
            lo, hi = np.searchsorted(row, [a, b])
            counts = np.bincount((row[lo:hi] - a) * len(kinds) + which[lo:hi], minlength=(b - a) * len(kinds)).reshape(b - a, len(kinds))
            kind = np.float32 if hi - lo < 2**24 else np.float64  # in which whole numbers stay exact
            for k in range(0, len(kinds), BOUND):
                out[a:b] += counts[:, k : k + BOUND].astype(kind) @ self.bind(kinds[k : k + BOUND]).astype(kind, copy=False)
        return out


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", binder: Binder | None = None) -> dict[str, np.ndarray]:
    """Prototypes by language from all rows with a language.

    Each task bundles its rows by language; what is shuffled is one vector per
    language and task. The driver and every task get one vector (4 KB) for each
    different value of the language column, which grow with the languages and not
    with the rows.
    """
    binder = binder or Binder()

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            for a, b in slices(texts, RUN):
                names = sorted(set(langs[a:b]))
                group = np.array([names.index(x) for x in langs[a:b]])
                for name, row in zip(names, binder.bundle(texts[a:b], group, len(names)), strict=True):
                    sums[name] = sums.get(name, 0) + row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.astype(np.int64).tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(frugal(bundles), "lang string, v array<long>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).collect()
    return {r["lang"]: np.array(r["v"], dtype=np.float64) for r in sorted(rows, key=lambda r: r["lang"])}


def length_class(text: np.ndarray, n: int) -> np.ndarray:
    """The class of each of ``n`` texts, from the indexes of their n-grams."""
    return np.searchsorted(LENGTHS, np.bincount(text, minlength=n), side="right")


def learn_least(labelled: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", lang_col: str = "lang", binder: Binder | None = None) -> dict[str, list[float]]:
    """By language the least cosine for each length class, from all rows with a language.

    What is shuffled is a quantile sketch per task, language and class.
    """
    binder = binder or Binder()
    unit = {n: v / np.linalg.norm(v) for n, v in prototypes.items() if np.any(v)}

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            for a, b in slices(texts, RUN):
                gram, text = binder.grams(texts[a:b])
                profile = binder.bundled(gram, text, b - a)
                norm = np.linalg.norm(profile, axis=1)
                use = np.flatnonzero((norm > 0) & np.array([x in unit for x in langs[a:b]], dtype=bool))
                own = [langs[a + i] for i in use.tolist()]
                score = [float(profile[i] @ unit[x]) / float(norm[i]) for i, x in zip(use.tolist(), own, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(length_class(text, b - a)[use].astype(np.int32)), pa.array(score, pa.float64())], names=["lang", "n", "c"])

    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(frugal(cosines), "lang string, n int, c double")
    low = {(r["lang"], r["n"]): r["low"] for r in rows.rollup("n", "lang").agg(F.percentile_approx("c", LOW, 10_000).alias("low"), F.count("*").alias("m")).where(F.col("m") >= LEAST_ROWS).collect()}
    out: dict[str, list[float]] = {}
    for name in unit:
        out[name], so_far = [], 0.0
        for k in range(len(LENGTHS) + 1):
            found = low.get((name, k), low.get((None, k)))  # a rollup's null stands for all languages
            so_far = so_far if found is None else max(0.0, SLACK * found)
            out[name].append(so_far)
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", binder: Binder | None = None) -> DataFrame:
    """``docs`` with a column ``made`` of lang_pred and score; narrow, no shuffle."""
    return docs.withColumn("made", predictor(prototypes, binder)(F.col(text_col)))


def predictor(prototypes: dict[str, np.ndarray], binder: Binder | None = None, least: dict[str, list[float]] | None = None):
    """The Arrow UDF text -> (lang_pred, score, least); the score is the cosine, at least 0, ``least`` what is asked of it."""
    binder = binder or Binder()
    names = [n for n, v in prototypes.items() if np.any(v)]
    asked = np.array([(least or {}).get(n, [0.0] * (len(LENGTHS) + 1)) for n in names]).reshape(len(names), len(LENGTHS) + 1)
    table = np.array([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names]).reshape(len(names), binder.dimensions)

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            texts = [t or "" for t in column]
            langs, scores, bounds = [], [], []
            for a, b in slices(texts, RUN):
                gram, text = binder.grams(texts[a:b])
                profile = binder.bundled(gram, text, b - a)
                norm = np.linalg.norm(profile, axis=1)
                lettered = norm > 0
                if not names:
                    langs += ["und"] * (b - a)
                    scores += [0.0] * (b - a)
                    bounds += [0.0] * (b - a)
                    continue
                cosine = (profile @ table.T) / np.where(lettered, norm, 1.0)[:, None]
                best = cosine.argmax(axis=1)
                langs += [names[i] if ok else "und" for i, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                scores += np.where(lettered, np.clip(cosine.max(axis=1), 0.0, 1.0), 0.0).tolist()
                bounds += asked[best, length_class(text, b - a)].tolist()
            yield pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": pd.Series(scores, dtype="float64"), "least": pd.Series(bounds, dtype="float64")})

    @F.pandas_udf("lang_pred string, score double, least double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from frugal(judged)(batches)

    return judge


def training_rows(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """Rows with a language outside the held-out fold."""
    return docs.where((fold_of(id_col) != 0) & F.col(lang_col).isNotNull())


def learned_judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """The UDF of ``predictor`` with prototypes and least cosines learned from ``training_rows``."""
    rows = training_rows(docs, id_col, lang_col)
    prototypes = learn(rows, text_col, lang_col)
    return predictor(prototypes, least=learn_least(rows, prototypes, text_col, lang_col))


def rejected(lang_pred: Column, score: Column, least: Column) -> Column:
    """A document is rejected if it has no language, or a cosine below ``least`` with the nearest learned one."""
    return (lang_pred == "und") | (score < least)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Learns from ``training_rows`` and predicts every row: id, held_out, lang_pred, score, rejected."""
    judge = learned_judge(docs, id_col, text_col, lang_col)
    made = docs.select(F.col(id_col), *keep, (fold_of(id_col) == 0).alias("held_out"), judge(F.col(text_col)).alias("made"))
    return made.select(id_col, *keep, "held_out", "made.lang_pred", "made.score", rejected(F.col("made.lang_pred"), F.col("made.score"), F.col("made.least")).alias("rejected"))
