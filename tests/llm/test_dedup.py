from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from framelake.llm import components, passages, simhash


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows, distance=2):
    code = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (code[i] ^ code[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{c:016x}", least.get(find(i))) for i, (d, c) in enumerate(zip((d for d, _ in rows), code))), key=repr)


def found(df):
    x = simhash.near_duplicates(df)
    return sorted(map(tuple, x.select("doc_id", simhash.hex_digits(x["code"]), "component_id").collect()), key=repr)


def near_copies(seed=2):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 6)))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rnd.choice([1, 2, 30, 300]))]
        for _ in range(rnd.choice([1, 3, 25])):
            own = list(base)
            if rnd.random() < 0.7:
                own[rnd.randrange(len(own))] = word()
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    return rows


def test_simhash_equals_brute_force(spark):
    rows = near_copies()
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == groups(rows)


def test_simhash_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(odd_docs) == groups(rows)
    assert found(no_docs) == []


def clustered(seed, groups=12, copies=60):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, groups, dtype=np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, groups, dtype=np.uint64)
    code = np.unique(np.concatenate([base ^ flip() ^ flip() for _ in range(copies)]))
    return code[np.argsort(simhash.gray_rank(code))]


@pytest.mark.parametrize("distance", [0, 1, 2, 6])
def test_gray_tree_finds_every_link(distance):
    code = clustered(distance)
    tree = simhash.GrayTree(code)
    got = {p for a, b in tree.search(code, distance) for p in zip(a.tolist(), b.tolist())}
    near = np.bitwise_count(code[:, None] ^ code[None, :]) <= distance
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))
    assert tree.pruned and tree.visited < len(code) ** 2
    for (_, count, above, _), (_, _, mask, _) in zip(tree.levels[1:], tree.levels):
        assert not (np.repeat(above, count) & mask).any()  # no bit is held by a node and the one above it


@pytest.mark.parametrize("size", [1, 5, 100])
def test_ranges_and_upper_nodes_lose_no_link(size):
    code = clustered(3)
    slot = simhash.slot_of(code)
    kinds, at, n = np.unique(slot, return_index=True, return_counts=True)
    upper = simhash.Upper(kinds, n, np.bitwise_and.reduceat(code, at), np.bitwise_or.reduceat(code, at), size)
    own = upper.own(code)
    assert (np.diff(own) >= 0).all() and own.max() + 1 == len(upper.first) > 1
    met = {p for a, b in upper.routed(code, 2) for p in zip(a.tolist(), b.tolist())}
    for i, j in zip(*np.nonzero(np.bitwise_count(code[:, None] ^ code[None, :]) <= 2)):
        assert own[i] >= own[j] or (i, own[j]) in met
    assert len(met) < len(code) * len(upper.first) / 2


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(300, 300), (301, 302), (302, 301)]
    got = {r.v: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[200 + i] for i in range(30)} == {100} and got[302] == 301 and 300 not in got


def cut(rows):
    """What passage removal leaves, by all windows of the input."""
    seen, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    for d, t in order:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            first = seen.setdefault(data[i : i + 100], (d, i))
            if first != (d, i):
                gone[i : i + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((d, len(data), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), kept))
    return sorted(out, key=repr)


def left(df):
    return sorted(((r.doc, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in passages.remove_repeats(df).collect()), key=repr)


def repetitive(seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    text = lambda n: [word() for _ in range(n)]
    base, line, rows = text(200), text(30), []
    for i in range(60):
        t = text(rnd.randint(1, 150))
        if i % 3 == 0:
            k = rnd.randint(0, 100)
            t[5:5] = base[k : k + rnd.randint(5, 90)]
        if i % 4 == 0:
            t += line
        if i % 7 == 0:
            t = list(base)
            t[rnd.randrange(200)] = "zzz"
        if i % 11 == 0:
            t = ["ab"] * rnd.randint(1, 400)
        rows.append((i, " ".join(t)))
    return rows + [(100, None), (101, ""), (102, "a" * 99), (103, "a" * 100), (104, "a" * 350), (105, "a" * 250 + "b" + "a" * 150), (106, rows[3][1])]


def test_passages_equal_brute_force(spark):
    rows = repetitive()
    assert left(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == cut(rows)


def test_passages_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert left(odd_docs) == cut(rows)  # the repeated row (id 4) counts as one document
    assert left(no_docs) == []
    kept = passages.remove_repeats(odd_docs, keep=("rest", "key")).select("rest.rest", "rest.key").distinct().collect()
    assert [tuple(r) for r in kept] == [("x", "k")]


def test_long_texts_are_cut_into_pieces_without_loss(spark, monkeypatch):
    rnd = random.Random(9)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    at = np.array([0, len(long)])
    whole = [p for g in passages.pieces(at) for p in g]
    monkeypatch.setattr(passages, "PIECE", 700)
    parts = [p for g in passages.pieces(at) for p in g]
    assert len(whole) == 1 and len(parts) > 3
    data = np.frombuffer(long.encode(), np.uint8)
    owned = lambda ps: sorted((a + int(o), w) for _, a, b in ps for o, lo, hi in zip(*passages.anchors(data[a:b], np.array([0, b - a]))) for w in range(a + int(lo), a + int(hi) + 1))
    assert owned(parts) == owned(whole)


def test_run_index_samples_suffice():
    rnd = random.Random(4)
    for letters, most in (("ab", 60), ("ab", 9), ("aé\x00", 40)):
        strings = [b"".join(rnd.choice(letters).encode() for _ in range(rnd.randint(0, most))) for _ in range(40)] + [b"ab" * 30, b"ab" * 30]
        index = passages.RunIndex(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]))
        suffix = [s[i:] for s in strings for i in range(len(s) + 1)]  # at each position, up to its mark
        order = sorted(range(index.n), key=lambda i: (suffix[i] + b"\xff", i))
        common = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        match, other = index.statistics()
        assert sorted(match.tolist()) == sorted([0, *(common(suffix[x], suffix[y]) for x, y in zip(order, order[1:]))])
        assert all(common(suffix[i], suffix[other[i]]) == match[i] and other[i] != i for i in range(index.n) if match[i])
        assert len(index.at) < index.n and index.run_length.sum() == index.n
        want = [i for i in range(index.n) if len(suffix[i]) >= 8 and any(suffix[j][:8] == suffix[i][:8] for j in range(i))]
        assert index.repeats(8).tolist() == want


def ordered_by_hash(rows):
    """Rows of one id in the order that the operator gives their texts."""
    mark = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42) & (2**63 - 1)
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, mark(r[1]) if r[0] is not None else -1 - mark(r[1])))


def cut_in_order(rows):
    """``cut`` of rows that may share ids, as if each different text had an id of its own."""
    numbered, names = [], []
    for r in ordered_by_hash(rows):
        if r not in names[-1:]:
            names.append(r)
        numbered.append((len(names) - 1, r[1]))
    return sorted(((names[d][0], *x) for d, *x in cut(numbered)), key=repr)


def test_passages_of_texts_that_share_an_id(spark):
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    base = text(600)
    rows = []
    for i in range(1500):  # enough for several 16-bit clashes within an id
        t = text(rnd.randint(150, 300))
        if i % 2:
            k = rnd.randint(0, 450)
            t = t[:50] + base[k : k + 150] + t[50:]
        rows.append((rnd.choice([None, None, 7, -(2**63)]), t))
    rows += rows[:5] + [(None, None), (None, ""), (7, None)]
    assert left(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == cut_in_order(rows)


@pytest.mark.parametrize("heavy", [0, 3])
def test_heavy_anchors_give_the_same_spans(spark, monkeypatch, heavy):
    rows = repetitive() + [(200 + i, f"{i:04d} " * 20 + "a common line between many others " * 2 + f"{i % 7:04d} " * 20) for i in range(60)]
    monkeypatch.setattr(passages.with_heavy, "__defaults__", (heavy, 100_000) if heavy else (1, 0))
    assert left(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == cut(rows)


def near_texts(seed=3, families=30):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    texts = []
    for _ in range(families):
        base = [word() for _ in range(rnd.choice([3, 60, 200]))]
        texts.append(base)
        for changes in (1, 2, 4, 8, 12):  # of which few of the longer texts stay at 0.8 or above
            own = list(base)
            for _ in range(changes):
                own[rnd.randrange(len(own))] = word()
            texts.append(own)
    return [(i * 7 % 1009, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]


def firsts_of_groups(rows):
    """The smallest id of each component of all pairs with five-word similarity of at least 0.8."""
    sets = {d: {tuple(w[i : i + 5]) for w in [(t or "").encode().lower().split()] for i in range(max(1, len(w) - 4))} for d, t, *_ in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(d for d in sets if find(d) == d)


def test_near_dedup_links_by_exact_five_word_similarity(spark):
    import corpus_pipeline as P
    from framelake.llm import similar

    rows = near_texts()
    want = firsts_of_groups(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, "").collect()) == want and len(want) < len(rows)
    alone = [similar.shingle_set(t) for _, t, *_ in rows]
    assert len(set(similar.clusters(alone).tolist())) == len(want)


def test_candidate_groups_in_chunks_lose_no_link(spark):
    from framelake.llm import similar

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    rows = near_texts(4, 6)
    base = [word() for _ in range(120)]
    for i in range(150):  # one large family, some of it near its edge, and chains of texts that drift away
        own = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5])):
            own[rnd.randrange(120)] = word()
        rows.append((2000 + i, " ".join(own), "en", "s", 1))
    drift = list(base)
    for i in range(40):
        drift[rnd.randrange(120)] = word()
        rows.append((3000 + i, " ".join(drift), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = firsts_of_groups(rows)
    for group in (400, 2500, 10**9):
        found = similar.near_duplicates(docs, group=group).collect()
        assert sorted({r.component_id for r in found}) == want and len(found) == len(rows), group
