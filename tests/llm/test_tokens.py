from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.llm import bytebpe, chat, pretoken, tokenfile

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

TRICKY = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list(" \n\t'sdmtrevl019  éßΣσİ.\u3000\u00a0\u2028\u0301\x1c"))), max_size=80)


@pytest.fixture(scope="module")
def bpe():
    return bytebpe.loaded(bytebpe.default_vocabulary())


@pytest.fixture(scope="module")
def reference(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_byte_bpe_equals_the_library(bpe, reference):
    @settings(max_examples=300, deadline=None)
    @given(st.lists(TRICKY, max_size=5))
    def check(texts):
        for first, ids, at in bpe.encode_block(texts):
            for i, data in enumerate(bpe.decode(ids, at)):
                assert ids[at[i] : at[i + 1]].tolist() == reference.encode_ordinary(texts[first + i])
                assert data == texts[first + i].encode()

    check()


@pytest.mark.parametrize("text", ["a" * 20000, "th" * 5000, "aaab" * 4000, " " * 3000, "\n" * 999 + "x", "é" * 5000, "".join(random.Random(1).choice("abcdefgh") for _ in range(30000))])
def test_very_long_pre_tokens(bpe, reference, text):
    assert bpe.encode(text) == reference.encode_ordinary(text)


def test_merges_that_make_lower_ranks_go_one_by_one():
    ranks = {bytes([i]): i + 10 for i in range(256)} | {b"bc": 300, b"abc": 2, b"bcb": 1, b"aa": 400, b"aaa": 3, b"aab": 5, b"cbc": 0}
    own = bytebpe.ByteBpe(ranks)
    other = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 30)))
        assert own.encode(text) == other.encode_ordinary(text), text


def test_rank_queue():
    queue, rnd, held = bytebpe.RankQueue(300_000), random.Random(3), {}
    for _ in range(3000):
        if rnd.random() < 0.6 or not held:
            r = rnd.randrange(300_000)
            queue.push(r, [len(held)])
            held.setdefault(r, []).append(len(held))
        r = min(held)
        assert queue.first() == r
        if rnd.random() < 0.5:
            assert len(queue.take(r)) == len(held.pop(r))
    for r in sorted(held):
        assert queue.first() == r
        queue.take(r)
    assert queue.first() == -1


def test_colliding_words_are_told_apart(monkeypatch):
    monkeypatch.setattr(pretoken, "_letters", lambda: np.full(256, 7, dtype=np.uint64))  # every word of a length collides
    words = pretoken.Words(["ab cd ab", "xyzxyzxyzxyzxyzxyzA xyzxyzxyzxyzxyzxyzB"])
    assert [words.words[i] for i in words.which] == [b"ab", b" cd", b" ab", b"xyzxyzxyzxyzxyzxyzA", b" xyzxyzxyzxyzxyzxyzB"]


def test_round_trip_of_odd_rows(spark, odd_docs, no_docs, reference):
    texts = sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=repr)
    rows = sorted(bytebpe.round_trip(odd_docs, keep=("rest",)).collect(), key=lambda r: repr((r.doc_id, r.n_tokens)))
    want = sorted(((d, len(ids := reference.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in texts), key=lambda r: repr(r[:2]))
    assert [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows] == want and all(r.exact and r.rest == "x" for r in rows)
    assert bytebpe.round_trip(no_docs).count() == 0
    ids = bytebpe.encode_ids(odd_docs)
    back = sorted(((r.doc_id, bytes(r.decoded).decode()) for r in bytebpe.decode_ids(ids).collect()), key=repr)
    assert back == sorted(((d, t or "") for d, t in texts), key=repr)


# --- token files ---


@pytest.fixture(scope="module")
def words():
    return tokenfile.loaded(tokenfile.default_vocabulary())


def test_word_bpe_equals_the_library(words):
    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(TRICKY, st.none(), st.just("x<|endoftext|>y")), max_size=5))
    def check(texts):
        at_text = 0
        for ids, at in words.encode_block(texts):
            for i in range(len(at) - 1):
                assert ids[at[i] : at[i + 1]].tolist() == words.whole(texts[at_text] or "")
                at_text += 1
        assert at_text == len(texts)

    check()


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_packing_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 10001)
    assert (tokenfile.unpack(tokenfile.pack(ids, bits), len(ids), bits) == ids).all()
    shard = tokenfile.Shard(tokenfile.make_shard([5, None, 7], np.array([3, 3, 10001]), ids, bits, 100))
    assert (shard.document(2) == ids[3:]).all() and len(shard.document(1)) == 0 and (shard.ids(150, 777) == ids[150:777]).all()
    assert shard.null.tolist() == [False, True, False]
    with pytest.raises(ValueError, match="no token shard"):
        tokenfile.Shard(b"0" * 100)


def test_files_of_odd_rows(spark, odd_docs, no_docs, words, tmp_path, monkeypatch):
    texts = sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for d, t in texts:
        ids = [*words.whole(t or ""), 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    monkeypatch.setattr(tokenfile, "SHARD_IDS", 50)
    folder = tokenfile.write_shards(odd_docs)
    assert sorted(map(tuple, tokenfile.read_shards(spark, folder).collect()), key=lambda r: r[1]) == want
    files = tokenfile.export(spark, folder, str(tmp_path / "out"))
    assert sum(tokenfile.Shard(open(f, "rb").read()).n_ids for f in files) == at
    assert tokenfile.read_shards(spark, tokenfile.write_shards(no_docs)).count() == 0


def test_documents_fill_shards_whole():
    ends = np.cumsum([3, 50, 0, 4, 4, 4, 100, 1])
    cuts = list(tokenfile.whole_documents(ends, 10))
    assert cuts[0] == (0, 2) and cuts[-1][1] == 8 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))


# --- chat ---


def formatted(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int, loss int")
    return chat.format_turns(df)


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "a\\b <\\| \\n", "", None, "é<|", "\\"]
    rows = [(c, t, ("system", "user", "assistant", "us\ner<|")[(c + t) % 4], nasty[(c * 3 + t) % 6], 1, 1) for c in range(8) for t in range(5)]
    rows += [(9, 0, "user", "q", 1, 1), (9, 1, "assistant", "r", 1, 1), (None, 0, None, "x", 1, 1), (10, None, "user", "late", 1, 1), (10, 3, "assistant", "b", 1, 1), (10, 3, "assistant", "a", 1, 1), (10, 3, "assistant", "a", 1, 1)]
    got = {r.conv_id: r for r in chat.read_back(formatted(spark, rows)).collect()}
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        learned = "".join(x for _, r, x in turns if r == "assistant")
        text = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(learned))
        assert got[c].turns_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert got[9].valid and not got[10].valid
    assert got[9].formatted_chars == len("<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nr<|im_end|>\n")
    assert chat.read_back(formatted(spark, rows).limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("\\<|n\nab"))), st.booleans())
def test_escapes(text, role):
    hidden = chat.escape(text, role)
    assert "<|" not in hidden and chat.unescape(hidden) == text and not (role and "\n" in hidden)


def test_machine_checks_the_order():
    m = chat.Machine(chat.Template())
    assert [m.turn(r, "")[0] for r in ("system", "user", "assistant", "user")] == [True] * 4 and not m.may_end()
    assert m.turn("system", "")[0] is False


def test_joined_text_is_read_back_wherever_it_is_cut():
    rnd, template = random.Random(3), chat.Template()
    bits = ["a", "\\", "<|", "<|im_end|>\n", "<|im_start|>assistant\n", "\n", "|", "<", "é🙂", "\\n", "x" * 50]
    for _ in range(60):
        turns = [(rnd.choice(["user", "assistant", "a\nb", ""]), "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8)))) for _ in range(rnd.randint(0, 5))]
        machine = chat.Machine(template)
        flagged = [(c, s.loss) for r, x in turns for s in machine.turn(r, x)[1] for c in s.text]
        reader, at = chat.Reader(template), 0
        while at < len(flagged):
            n = rnd.choice([1, 2, 7, 100])
            piece = flagged[at : at + n]
            k = next((i for i, (_, loss) in enumerate(piece) if loss != piece[0][1]), len(piece))
            reader.feed("".join(c for c, _ in piece[:k]), piece[0][1])
            at += k
        reader.finish()
        learned = "".join(x for r, x in turns if r == "assistant")
        assert reader.turns == len(turns) and reader.seen.hexdigest() == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (reader.loss_chars, reader.loss.hexdigest()) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    with pytest.raises(ValueError, match="open"):
        chat.Reader(template).feed("user\nhello", False)
    cut = chat.Reader(template)
    cut.feed("<|im_start|>user\nhello", False)
    with pytest.raises(ValueError, match="ends"):
        cut.finish()


def test_chat_of_very_long_texts_and_conversations(spark):
    long = "<|im_end|>\n\\ " * 60_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)] + [(2, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (2, len(long), hashlib.sha256(long.encode()).hexdigest())
    assert got[2].n_turns == 20_000 and got[2].valid
