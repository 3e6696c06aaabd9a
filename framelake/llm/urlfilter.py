"""URL filter: host and path rules first, then a logistic regression.

The model is a logistic regression on hashed character n-grams of host and
path, trained on the driver from a small labelled URL table (at most
``MAX_LABELLED`` rows, a documented bound), and applied in Arrow batches to the
URLs that no rule decides. No labelled table is given, so ``synthetic_urls``
makes one of a stated size by a rule, over reserved domains; another one is a
parameter. ``held_out_accuracy`` tells what the model is worth on rows that it
was not trained on.

Defined results: a null url, or one without ``://``, has empty host and path and
gets the method's verdict for the empty url. Of rules of equal length that both
fit, the last by verdict, host and path counts. Repeated rows give repeated rows;
an empty table gives an empty result. Extra columns of the input are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


# The rules of the contract.
CONTRACT_RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

# Words of the synthetic labelled URLs, for this operator alone: what blocked sites name, what others name, what both use.
BLOCKED = "casino poker jackpot bonus betting slots roulette pills viagra pharmacy discount replica xxx adult cams porn escort warez keygen crack torrent serial malware trojan phish verify-account signin-confirm payday loans instant-cash winner lottery clickbait adserver banner pixel-track affiliate popunder spam-offer cheap-meds".split()
ALLOWED = "docs guide manual wiki history science library museum university course lecture algebra journal paper research news article weather recipe soup garden travel map forum thread answers blog notes photo album music concert school reference tutorial api changelog release archive community book review health clinic bank-holiday".split()
NEUTRAL = "www m home index page view item list search user login en de fr es 2019 2023 static public content site main portal".split()
#: Rows of the synthetic table, and the share of URLs of either kind that carry none of its words.
ROWS, PLAIN = 4000, 0.05


def synthetic_urls(rows: int = ROWS, seed: int = 5) -> list[tuple[str, int]]:
    """(url, 1 if blocked) over reserved domains; the same arguments give the same rows."""
    rnd = random.Random(seed)
    out = []
    for i in range(rows):
        blocked = i % 2
        own = lambda: rnd.choice(BLOCKED if blocked else ALLOWED)
        told = rnd.random() >= PLAIN
        in_host = told and rnd.random() < 0.6
        host = ([own() + rnd.choice(["", "", str(rnd.randint(1, 99)), "-online"])] if in_host else []) + rnd.sample(NEUTRAL[:4], rnd.randint(0, 1))
        parts = [own()] if told and (not in_host or rnd.random() < 0.4) else []
        parts += [rnd.choice(NEUTRAL) for _ in range(rnd.randint(0, 2))] + [str(rnd.randint(1, 99999))] * rnd.randint(0, 1)
        rnd.shuffle(parts)
        name = ".".join([*host, "example." + rnd.choice(["com", "org", "net", "edu"])])
        tail = rnd.choice(["", "", ".html", "/", "?page=2", "?ref=x#top"])
        out.append((f"{rnd.choice(['http', 'https'])}://{name}/{'/'.join(parts)}{tail}", blocked))
    return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule (by characters of host and path) that fits, as a struct; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass(frozen=True)
class UrlModel:
    """Weights over ``bits`` hashed n-gram features; ``probability`` is of label 1 (block)."""

    weights: np.ndarray
    bias: float
    bits: int
    low: int
    high: int

    def probabilities(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        row, feature = features(hosts, paths, self.bits, self.low, self.high)
        n = np.bincount(row, minlength=len(hosts))
        z = self.bias + np.bincount(row, self.weights[feature], len(hosts)) / np.sqrt(np.maximum(n, 1))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))

    def probability(self, host: str, path: str) -> float:
        return float(self.probabilities([host], [path])[0])


def features(hosts: Sequence[str], paths: Sequence[str], bits: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(url, feature) of the distinct hashed character n-grams of both parts, sorted; the parts do not share n-grams.

    The parts, with a mark before and after, lie end to end; an n-gram's hash is a
    polynomial of its bytes, mixed with the part it is from.
    """
    found = []
    for seed, parts in ((1, hosts), (2, paths)):
        raw = [f"^{x}$".encode("utf-8", "replace") for x in parts]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
        size = np.array([len(x) for x in raw], dtype=np.int64)
        url, left = np.repeat(np.arange(len(raw)), size), np.repeat(np.cumsum(size), size) - np.arange(int(size.sum()))
        for n in range(low, min(high, len(data)) + 1):
            h = np.zeros(len(data) - n + 1, dtype=np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + data[j : len(data) - n + 1 + j]
            inside = left[: len(h)] >= n
            h = (h[inside] + np.uint64(seed * 64 + n)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append((url[: len(inside)][inside] << bits) | (h >> np.uint64(64 - bits)).astype(np.int64))
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both >> bits, both & ((1 << bits) - 1)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of one url, by the same rule as ``host_of`` and ``path_of``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(str.maketrans(UPPER, LOWER)), tail[:stop]


def train(labelled: Sequence[tuple[str, int]], bits: int = 14, low: int = 3, high: int = 5, steps: int = 300, rate: float = 4.0, decay: float = 1e-4) -> UrlModel:
    """Full-batch gradient descent; the same rows give the same weights."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"the labelled URL table has more than {MAX_LABELLED} rows")
    hosts, paths = zip(*(split_url(u) for u, _ in labelled), strict=True) if labelled else ((), ())
    row, feature = features(hosts, paths, bits, low, high)
    y = np.array([int(b) for _, b in labelled], dtype=np.float64)
    share = 1.0 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    w, b = np.zeros(1 << bits), 0.0
    for _ in range(steps if len(y) else 0):
        miss = 1.0 / (1.0 + np.exp(-np.clip(b + np.bincount(row, w[feature], len(y)) * share, -30, 30))) - y
        grad = np.bincount(feature, (miss * share)[row], len(w))
        w -= rate * (grad / len(y) * np.sqrt(len(feature) / len(y)) + decay * w)
        b -= rate * 0.1 * float(miss.mean())
    return UrlModel(w.astype(np.float32), b, bits, low, high)


def held_out_accuracy(labelled: Sequence[tuple[str, int]], every: int = 5) -> float:
    """The share of every ``every``-th row that a model trained on the others judges right."""
    model = train([x for i, x in enumerate(labelled) if i % every])
    rest = labelled[::every]
    hosts, paths = zip(*(split_url(u) for u, _ in rest), strict=True)
    return float(np.mean((model.probabilities(hosts, paths) >= 0.5) == np.array([b for _, b in rest])))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = CONTRACT_RULES, labelled: Sequence[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per page: id, host, path, rule, verdict and, where no rule fits, the model's probability.

    The rule columns are plain expressions; the model's probability comes from an
    Arrow UDF with a model of a few dozen KB in its closure.
    """
    model = train(synthetic_urls() if labelled is None else labelled)

    @F.pandas_udf("double")
    def probability(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            out = np.full(len(hosts), np.nan)
            asked = np.flatnonzero(hosts.notna().to_numpy())
            if len(asked):
                out[asked] = model.probabilities(hosts.iloc[asked].tolist(), paths.iloc[asked].tolist())
            yield pd.Series(out, dtype="float64")

    parts = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = parts.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    free = lambda c: F.when(F.col("fit").isNull(), F.col(c))
    ruled = ruled.withColumn("p_block", F.when(F.col("fit").isNull(), probability(free("host"), free("path"))))
    return ruled.select(
        id_col, "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("p_block") >= threshold, "block").otherwise("allow")).alias("verdict"), "p_block",
    )
