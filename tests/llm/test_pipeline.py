"""The pipeline against a brute-force version of its stages on a small table."""

from __future__ import annotations

import gc
import hashlib
import time

import pytest
import tiktoken
from oracle import SF
from test_dedup import cut, firsts_of_groups
from test_filters import brute as hits
from test_filters import brute_languages

import corpus_pipeline as P
from framelake.llm import bytebpe
from framelake.llm.common import read_table, tidy


def table(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_every_stage_equals_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    spoken = [(d, t) for (d, t, _), (_, lang, score, least) in zip(rows, brute_languages(rows)) if lang != "und" and score >= least]
    kept = [docs]
    for _, stage in P.STAGES:
        kept.append(stage(spark, kept[-1], SF).checkpoint())
    for df in kept[1:-1]:
        assert df.columns == docs.columns
    assert table(kept[1]) == sorted(spoken)
    first = set(firsts_of_groups(spoken))
    single = [(d, t) for d, t in spoken if d in first]
    assert table(kept[2]) == sorted(single) and len(single) < len(spoken)
    left = [(d, t) for d, t, n in ((d, k.decode("utf-8", "ignore"), n) for d, _, n, _, k in cut(single)) if t or not n]
    assert table(kept[3]) == sorted(left) and all(r.n_chars == len(r.text) for r in kept[3].collect())
    bad = {h[0] for h in hits(left, items) if h[2]}
    pure = sorted((d, t) for d, t in left if d not in bad)
    assert table(kept[4]) == pure and len(pure) < len(left)
    bpe = bytebpe.loaded(bytebpe.default_vocabulary())
    library = tiktoken.Encoding("own", pat_str=__import__("public_tokenizers").PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    want = [(d, len(ids := library.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in pure]
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in kept[5].collect()) == want
    assert P.run(spark, SF).count() == len(want)


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs):
    few = odd_docs.drop("key")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, no_docs, SF).count() == 0, name
        assert stage(spark, few, SF).columns == few.columns
    ids = [r.doc_id for r in P.near_dedup(spark, odd_docs, SF).collect()]
    assert ids.count(4) == 1 and 5 not in ids and 2 not in ids and None in ids
    assert {r.doc_id for r in P.language_id(spark, odd_docs, SF).collect()} >= {4, 5, 6, 7, 9, None}


def test_every_stage_begins_with_a_returned_heap(spark, no_docs, monkeypatch):
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    garbage = [spark._jvm.java.nio.ByteBuffer.allocate(64 << 20) for _ in range(8)]
    full = runtime.totalMemory()
    del garbage
    gc.collect()
    time.sleep(1)  # the JVM is told a little later
    tidy(spark)
    assert runtime.totalMemory() < full - (200 << 20)

    def called(session):
        raise InterruptedError

    monkeypatch.setattr(P, "tidy", called)
    for _, stage in P.STAGES:
        with pytest.raises(InterruptedError):
            stage(spark, no_docs.drop("key"), SF)
