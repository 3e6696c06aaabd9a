from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import topk


def brute(rows, k=5, scale=256):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in kept:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in kept if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit("x"), "rank": F.lit(0), "block": F.lit(1)})
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))


def test_equals_brute_force_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 16).astype(np.float32).tolist()) for i in range(230)]
    rows += [(i, rows[3][1]) for i in range(230, 300)]  # ties
    rows += [(50, rows[7][1]), (1, rows[1][1])]  # repeated ids
    rows += [(900, None), (950, [float("nan")] * 16), (951, [None, 1.0]), (952, [float("inf")] * 16), (None, [1.0] * 16), (1000, [0.5] * 3), (1050, [])]
    assert run(spark, rows) == brute(rows)


def test_fewer_rows_than_k_and_none(spark):
    rows = [(0, [1.0, -1.0]), (7, [0.5, 0.5])]
    assert run(spark, rows) == brute(rows) == [(0, 1, 7, 0)]
    assert run(spark, [(3, [1.0])]) == []
    assert run(spark, []) == []


def test_an_invalid_vector_of_a_repeated_id_takes_no_part(spark):
    for odd in ([None, 1.0], [float("-inf"), 1.0], [float("nan"), 1.0], None):
        rows = [(0, odd), (0, [0.5, 0.5]), (7, [1.0, 0.25]), (8, [0.25, -1.0])]
        assert run(spark, rows) == brute(rows) and len(run(spark, rows)) == 2


def test_several_shards_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.normal(0, 1, (8, 12))
    rows = [(i, (centre[i % 8] + rng.normal(0, 0.1, 12)).astype(np.float32).tolist()) for i in range(3000)]
    want = brute(rows)
    monkeypatch.setattr(topk, "SHARD", 100)
    monkeypatch.setattr(topk, "QUERIES", 7)
    assert run(spark, rows) == want
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    shards, blocks, pairs = topk.prepared(df, F.col("vec_id") % 50 == 0, 5, "vec_id", "embedding", 256.0)
    assert pairs.count() < 0.8 * shards.count() * blocks.count()


def search(shard, query_id, query, k):
    return shard.search(np.array([query_id]), np.array([query]), np.array([-np.inf]), k)[0]


def test_great_values_are_exact():
    ids, values = np.array([1, 2, 3]), np.array([[2.0**40, 1.0], [2.0**40, 2.0], [-(2.0**62), 0.0]])
    shard = topk.Shard(ids, values)
    assert search(shard, 9, np.array([2.0**20, 3.0]), 2) == [(2**60 + 6, 2), (2**60 + 3, 1)]
    with pytest.raises(OverflowError):
        search(shard, 9, np.array([2.0**20, 3.0]), 3)


@pytest.mark.parametrize("seed", range(4))
def test_shards_skip_nothing(seed):
    rng = np.random.default_rng(seed)
    values = np.floor(rng.normal(0, 40, (1500, 24)) * (rng.random(24) ** 4))
    ids = rng.permutation(1500)
    shard = topk.Shard(ids, values)
    together = shard.search(ids[:5], values[:5], np.full(5, -np.inf), 5)
    for q in range(5):
        scores = values @ values[q]
        want = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != ids[q])[:5]
        assert [(-s, i) for s, i in search(shard, int(ids[q]), values[q], 5)] == want == [(-s, i) for s, i in together[q]]
