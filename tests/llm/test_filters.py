from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from oracle import SF

from framelake.llm import decontam, langid, toxic, urlfilter
from framelake.llm.common import read_table


# --- decontamination ---


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit |= set(range(k, k + n))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return sorted(out, key=repr)


def judged(docs, items):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in decontam.decontaminate(docs, items).collect()), key=repr)


def test_decontamination_equals_brute_force(spark, odd_docs, no_docs, monkeypatch):
    rnd = random.Random(1)
    line = lambda n: [rnd.choice(["the", "of", "and", "Rare%d" % rnd.randint(0, 9), "é-e", "x_y", "12"]) for _ in range(n)]
    items = [(i, " ".join(line(rnd.choice([1, 3, 9, 10, 11, 40])))) for i in range(30)] + [(3, "again, the third"), (None, "no id at all in this one"), (31, None), (32, "!!"), (33, "")]
    docs = []
    for i in range(80):
        t = line(rnd.randint(0, 60))
        if i % 3 == 0:
            at = rnd.randint(0, len(t))
            t[at:at] = items[i % 30][1].upper().split()
        docs.append((i, " ".join(t)))
    docs += [(80, None), (80, None), (81, items[5][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert judged(d, b) == want and any(r[2] for r in want)
    monkeypatch.setattr(decontam, "PART", 600)  # several parts
    assert judged(d, b) == want
    assert judged(odd_docs, b) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], items)
    assert judged(no_docs, b) == [] and all(r[2] == 0 for r in judged(d, b.limit(0)))


def test_a_stored_shard_is_read_back_and_intersects_its_lists():
    rnd = random.Random(2)
    texts = [[rnd.choice([b"a", b"b", b"c", b"dd"]) for _ in range(rnd.randint(0, 40))] for _ in range(30)]
    shard = decontam.PositionalShard.loaded(*decontam.PositionalShard.of(texts).stored())
    flat = [w for t in texts for w in t]
    for w in (b"a", b"dd", b"none"):
        assert shard.positions(w).tolist() == [i for i, x in enumerate(flat) if x == w]
    items = [(str(i), " ".join(x.decode() for x in rnd.choice([t for t in texts if len(t) > 5])[1:5])) for i in range(8)]
    wanted = decontam.Phrases.windows(items, 4)
    found = {(wanted.names[n], int(s)) for p, s in zip(*shard.phrases(wanted)) for n in wanted.item[wanted.item_begin[p] : wanted.item_begin[p + 1]]}
    at = [(0, 0)]
    for t in texts:
        at.append((at[-1][0] + len(t), 0))
    want = {(n, at[d][0] + k) for n, x in items for d, t in enumerate(texts) for k in range(len(t) - 3) if t[k : k + 4] == x.encode().split()}
    assert found == want and want
    assert decontam.PositionalShard.loaded(*decontam.PositionalShard.of([]).stored()).n == 0


def test_phrase_and_proximity_search(spark):
    docs = spark.createDataFrame([(1, "a b c a b"), (2, "b x x a"), (3, None)], "doc_id long, text string")
    exact = sorted(map(tuple, decontam.search(docs, [("q", "A b"), ("none", "zz")]).collect()))
    assert exact == [(1, "q", 0), (1, "q", 3)]
    near = sorted(map(tuple, decontam.search(docs, [("q", "a b")], slop=3).collect()))
    assert {r[0] for r in near} == {1, 2} and {r[0] for r in decontam.search(docs, [("q", "a b")], slop=2).collect()} == {1}


# --- language ID ---


def test_languages_on_held_out_rows(spark):
    docs = read_table(spark, SF, "documents")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.9 and all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(spark, odd_docs, no_docs):
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(odd_docs).collect()}
    assert {p for d, p in got if d in (1, 2, 3, 8)} == {"und"} and (9, "lang") in got and (None, "lang") in got
    assert langid.identify(no_docs).count() == 0
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(none).collect()] == ["und"]


def brute_languages(docs):
    """(lang, score, least) by id: letters' vectors bound, bundled and compared one by one."""
    binder, profiles, sizes = langid.Binder(), {}, {}
    for i, (_, t, _) in enumerate(docs):
        total, words = np.zeros(binder.dimensions), "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        grams = [f" {w} "[k : k + 3] for w in words for k in range(len(w))]
        for g, n in Counter(grams).items():
            v = np.ones(binder.dimensions)
            for place, c in enumerate(reversed(g)):
                v = v * np.roll(binder.letter(ord(c)), place)
            total += n * v
        profiles[i], sizes[i] = total, sum(len(grams) >= x for x in langid.LENGTHS)
    learned = {}
    own = [i for i, (d, _, lang) in enumerate(docs) if lang is not None and d is not None and zlib.crc32(str(d).encode()) % 5]
    for i in own:
        learned[docs[i][2]] = learned.get(docs[i][2], 0) + profiles[i]
    names = sorted(n for n, v in learned.items() if v.any())
    cosine = lambda i, n: float(profiles[i] @ learned[n] / np.linalg.norm(profiles[i]) / np.linalg.norm(learned[n]))
    seen = {}
    for i in own:
        if profiles[i].any() and docs[i][2] in names:
            for key in ((docs[i][2], sizes[i]), (None, sizes[i])):
                seen.setdefault(key, []).append(cosine(i, docs[i][2]))
    low = {k: sorted(x)[max(0, -(-len(x) // 1000) - 1)] for k, x in seen.items() if len(x) >= langid.LEAST_ROWS}
    least = {}
    for n in names:
        at = 0.0
        for k in range(len(langid.LENGTHS) + 1):
            found = low.get((n, k), low.get((None, k)))
            at = at if found is None else max(0.0, langid.SLACK * found)
            least[n, k] = at
    out = []
    for i, (d, _, _) in enumerate(docs):
        if not names or not profiles[i].any():
            out.append((d, "und", 0.0, 0.0))
            continue
        scores = [cosine(i, n) for n in names]
        best = max(range(len(names)), key=lambda k: (round(scores[k], 9), -k))
        out.append((d, names[best], min(1.0, max(0.0, scores[best])), least[names[best], sizes[i]]))
    return out


def test_languages_equal_brute_force_on_a_whole_table(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    want = sorted(brute_languages(rows))
    got = sorted((r.doc_id, r.lang_pred, r.score, r.rejected) for r in langid.identify(docs).collect())
    assert len(got) == len(want)
    for (d, lang, score, out), (e, name, x, least) in zip(got, want):
        assert (d, lang) == (e, name) and abs(score - x) < 1e-6 and (abs(x - least) < 1e-9 or out == (lang == "und" or x < least))


def test_ties_between_languages_go_to_the_first_and_repeated_rows_stay(spark):
    rows = [(i, "abc abd", lang) for i, lang in enumerate(["zz", "aa"] * 10)] + [(3, "abc abd", "mm")] * 2 + [(50, None, "aa"), (51, "", "zz")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id < 50} == {"aa"} and {r.lang_pred for r in got if r.doc_id >= 50} == {"und"}


def test_texts_of_an_unlearned_language_are_rejected(spark):
    import corpus_pipeline as P

    docs = read_table(spark, "/root/testdata/sf0.1", "documents")
    odd = ["Это совершенно обычный текст на русском языке о погоде и рынке в городе.", "xqzt wvkj qqpx zzkw jxvq kkqz vvxj qwzk pqxz jjkq zxvw", "Ez egy teljesen hétköznapi magyar mondat az időjárásról és a piacról"]
    extra = spark.createDataFrame([(10**9 + i, t * 5, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(extra)
    rows = {r.doc_id: r for r in langid.identify(both).collect()}
    assert all(rows[10**9 + i].rejected for i in range(len(odd)))
    clean = [r for d, r in rows.items() if d < 10**9]
    assert sum(r.rejected for r in clean) <= 0.005 * len(clean)
    kept = {r.doc_id for r in P.language_id(spark, both, "").collect()}
    assert kept == {d for d, r in rows.items() if not r.rejected}


def test_bundles_add_up_whatever_the_split():
    binder, texts = langid.Binder(64), ["abc abd", "", "xyz é", "a b", "ab" * 50]
    whole = binder.bundle(texts)
    assert np.array_equal(whole, np.concatenate([binder.bundle([t]) for t in texts]))
    assert np.array_equal(binder.bundle(texts, np.array([0, 1, 0, 1, 0]), 2), np.stack([whole[[0, 2, 4]].sum(0), whole[[1, 3]].sum(0)]))
    vector = np.roll(binder.letter(32), 2) * np.roll(binder.letter(ord("a")), 1) * binder.letter(32)
    assert np.array_equal(binder.bundle(["a"])[0], vector)


# --- toxicity ---


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_automaton_along_the_trie_finds_all_near_words(edits):
    rnd = random.Random(edits)
    lexicon = sorted({bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 8))) for _ in range(60)})
    for _ in range(200):
        w = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 9)))
        assert sorted(toxic.Levenshtein(w, edits).along(toxic.Trie(lexicon))) == [(i, edit_distance(w, x)) for i, x in enumerate(lexicon) if edit_distance(w, x) <= edits]


def test_quotation_counts_apart_from_abuse():
    m = toxic.Matcher(["idiot"], [1.0])
    plain, wrong, quoted, said, none = m.features(["you idiot there", "you idoit idjot there", 'the word " idiot " here', "he said idiot here", None])
    assert plain[0] > 0 and plain[2] == 0 and wrong[1] > 0 and wrong[0] == 0 and quoted[2] > 0 and quoted[0] == 0 and said[2] > 0 and not none.any()


def test_misspellings_with_symbols_and_of_other_letters_match():
    m = toxic.Matcher(["idiot", "stupid", "imbécile", "дурак"], [1.0, 1.0, 1.0, 1.0])
    texts = ["you id1ot there", "so st*pid, really", "an imbecile here", "ты дура здесь", "(id.iot)", "an imbécile1 here"]
    for f in m.features(texts):
        assert f[0] + f[1] > 0 and f[2] == 0
    assert m.features(["id1ot"])[0, 1] == np.log1p(1.0)
    assert not m.features(["id 1 ot", "id12ot", "st**pid", "id1", "ot", "дом"]).any()


def toxic_tables(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 6)))
    docs, labels = [], []
    for i in range(600):
        t, bad = [word() for _ in range(40)], i % 4 == 0
        if bad:
            for _ in range(3):
                t.insert(rnd.randrange(len(t)), rnd.choice(["vilest", "rotten", "wretched"]))
        docs.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    docs.append((600, " ".join([word() for _ in range(20)] + ["wretchd", "vylest", "rottten"])))
    return spark.createDataFrame(docs + [(601, None), (602, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark, odd_docs, no_docs):
    docs, labels = toxic_tables(spark)
    model = toxic.learn(docs, labels)
    assert set(model.words) == {"vilest", "rotten", "wretched"}
    rows = {r.doc_id: r for r in toxic.score(docs, model).collect()}
    held = [r for d, r in rows.items() if d < 600 and r.held_out]
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in held) and len(held) > 80
    assert rows[601].score == rows[602].score < 0.5
    assert toxic.score(odd_docs, model).count() == 13 and toxic.score(no_docs, model).count() == 0
    assert {r.score for r in toxic.score(docs, toxic.learn(docs, labels.limit(0))).collect()} == {0.0}


PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def brute_features(text, words, weights, known):
    """A text's sums, from pieces found by a regular expression and edit distances to every lexicon word."""
    low = (text or "").lower()
    pieces = [(m.group(), m.start(), m.end()) for m in regex.finditer(PIECES, low)]

    def near(w):
        if w not in known:
            known[w] = nearest(w)
        return known[w]

    def nearest(w):
        if w in words:
            return words.index(w), 0
        found = [(1, i) for i, x in enumerate(words) if (len(x) >= 5 and edit_distance(w, x) <= 1) or (len(x) < 5 <= len(x.encode()) and edit_distance(w.encode(), x.encode()) <= 1)]
        return (min(found)[1], 1) if found else (-1, 0)

    hits = [(k, k + 1, *near(w)) for k, (w, _, _) in enumerate(pieces)]
    hits = [h for h in hits if h[2] >= 0]
    matched = {h[0] for h in hits}
    for k in range(len(pieces) - 2):
        (a, _, x), (b, y, z), (c, u, _) = pieces[k : k + 3]
        if a.isalpha() and c.isalpha() and len(b) == 1 and not b.isalpha() and x == y and z == u and k not in matched and k + 2 not in matched and (i := near(a + b + c)[0]) >= 0:
            hits.append((k, k + 3, i, 1))
    marks = {q for q in toxic.QUOTES.split()}
    is_mark = [any(w.encode() in {q.encode()} or w.encode()[:n] == q.encode() or w.encode()[-n:] == q.encode() for q in marks for n in (len(q.encode()),)) for w, _, _ in pieces]
    is_report = [w in toxic.REPORTING.split() for w, _, _ in pieces]
    out, kinds = np.zeros(5), set()
    for k, end, i, edits in hits:
        lo, hi = max(0, k - toxic.WINDOW), min(len(pieces), end + toxic.WINDOW)
        quoted = (any(is_mark[lo:k]) and any(is_mark[end:hi])) or any(is_report[lo:hi])
        out[2 if quoted else 1 if edits else 0] += weights[i]
        if not quoted:
            kinds.add(i)
    out[3], out[4] = len(kinds), out[0] / max(len(pieces), 20) * 100
    return np.log1p(out)


def test_toxicity_equals_brute_force_on_a_whole_table(spark):
    docs = read_table(spark, SF, "documents")
    model = toxic.learn(read_table(spark, "/root/testdata/sf0.01", "documents"), read_table(spark, "/root/testdata/sf0.01", "labels"))
    assert model.words
    extra = [(10**6 + i, f"so {w[:2]}*{w[3:]} and {w[:-1]}x, he said {w}; \"{w}\" a {w[1:]}") for i, w in enumerate(model.words)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    score = {r.doc_id: r.score for r in toxic.score(both, model).collect()}
    hit, known = 0, {}
    for d, t in both.collect():
        f = brute_features(t, list(model.words), model.weights, known)
        assert abs(score[d] - float(model.scores(f[None])[0])) < 1e-9, t
        hit += bool(f.any())
    assert hit > len(extra) / 2


# --- URLs ---


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("https://A.Example.COM/en/1?x=/de/", "a.example.com", "/en/1", "com/en/", "block"),
    ("http://example.com/en/71#t", "example.com", "/en/71", "example.com/en/7", "allow"),
    ("x://net/de/9", "net", "/de/9", "net/de/", "allow"),
    ("x://a.example.net/de/8", "a.example.net", "/de/8", "example.net/de/8", "block"),
    ("x://myexample.net/de/8", "myexample.net", "/de/8", "net/de/", "allow"),
    ("x://q.org/es/", "q.org", "/es/", "org/es/", "block"),
    ("x://q.org?/es/", "q.org", "", None, None),
    ("x://Ä.org\n/es/", "Ä.org\n", "/es/", None, None),
    ("x://q.org/ES/", "q.org", "/ES/", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
])
def test_url_parts_and_rules(spark, url, host, path, rule, verdict):
    r = urlfilter.judge_urls(spark.createDataFrame([(1, url, "h")], "page_id long, url string, host string")).first()
    assert (r.host, r.path, r.rule) == (host, path, rule) and (r.verdict == verdict if verdict else r.verdict in ("allow", "block"))
    assert urlfilter.split_url(url) == (host, path)


def test_url_model(spark):
    table = urlfilter.synthetic_urls()
    assert len(table) == urlfilter.ROWS and table == urlfilter.synthetic_urls() and urlfilter.held_out_accuracy(table) >= 0.9
    model = urlfilter.train(table)
    assert model.probability(*urlfilter.split_url("http://casino.example.org/poker/bonus")) > 0.9 > 0.1 > model.probability(*urlfilter.split_url("http://docs.example.org/guide"))
    assert np.array_equal(model.weights, urlfilter.train(table).weights)
    assert urlfilter.judge_urls(read_table(spark, SF, "pages").limit(0)).count() == 0
    with pytest.raises(ValueError, match="more than"):
        urlfilter.train([("x", 1)] * (urlfilter.MAX_LABELLED + 1))
    assert urlfilter.train([]).probability("a", "/b") == 0.5


def one_probability(model, host, path):
    """The model's probability from n-grams taken one by one."""
    grams = set()
    for seed, part in ((1, host), (2, path)):
        raw = f"^{part}$".encode()
        for n in range(model.low, model.high + 1):
            for i in range(len(raw) - n + 1):
                h = 0
                for c in raw[i : i + n]:
                    h = (h * 0x100000001B3 + c) % 2**64
                h = (h + seed * 64 + n) * 0x9E3779B97F4A7C15 % 2**64
                grams.add(((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 % 2**64) >> (64 - model.bits))
    z = model.bias + (sum(float(model.weights[g]) for g in grams) / len(grams) ** 0.5 if grams else 0)
    return 1 / (1 + np.exp(-z))


def test_every_page_is_judged_as_by_an_independent_version(spark):
    from oracle import connect

    from framelake.llm import sql

    model, got = urlfilter.train(urlfilter.synthetic_urls()), {}
    odd = [(10**6, None), (10**6 + 1, "none"), (10**6 + 2, "x://" + "a" * 50_000 + "/" + "b" * 50_000), (10**6 + 3, "x://q.org/es/"), (10**6 + 3, "x://q.org/es/"), (10**6 + 4, "x://h/?")]
    pages = read_table(spark, SF, "pages").select("page_id", "url").union(spark.createDataFrame(odd, "page_id long, url string"))
    rows = urlfilter.judge_urls(pages).collect()
    assert len(rows) == pages.count()
    for r in rows:
        got[r.page_id] = r
        assert (r.p_block is None) == (r.rule is not None)
        if r.rule is None:
            assert abs(r.p_block - one_probability(model, r.host, r.path)) < 1e-5
            assert r.verdict == ("block" if r.p_block >= 0.5 else "allow")
    want = connect(SF).sql(sql.URL_RULES).fetchall()
    assert want and all((got[i].host, got[i].path, got[i].rule) == (h, p, r) and v in (None, got[i].verdict) for i, h, p, r, v in want)


def test_rules_of_equal_length(spark):
    rules = (urlfilter.Rule("allow", "a.b", "/c"), urlfilter.Rule("block", "b", "/c/d"))
    df = spark.createDataFrame([(1, "x://a.b/c/d")], "page_id long, url string")
    assert urlfilter.judge_urls(df, rules=rules).first().verdict == urlfilter.judge_urls(df, rules=rules[::-1]).first().verdict == "block"
