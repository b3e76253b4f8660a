import random
import zlib
from functools import cache

import numpy as np
import pytest
from helpers import ODD, documents

from kgweave.llm import token_codes, token_rollup
from kgweave.llm.queries import tokenizer_path

pytest.importorskip("public_tokenizers")


@cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def whole_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_levels_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for ids in ([], [0], [255, 256, 65535, 65536, 2**32 - 1], rng.integers(0, 50257, 3000), np.zeros(1500)):
        ids = np.array(ids, np.uint32)
        levels = token_codes.Levels(token_codes.encode_levels(ids))
        assert (levels.all() == ids).all() and len(levels) == len(ids)
        for i in rng.integers(0, len(ids), min(len(ids), 200)) if len(ids) else []:
            assert levels[int(i)] == ids[i]
    with pytest.raises(IndexError):
        token_codes.Levels(token_codes.encode_levels(np.zeros(3, np.uint32)))[3]


def test_kept_words_give_the_library_s_ids(monkeypatch):
    rng = random.Random(1)
    bits = ["a", "the", "it's", "we'll", "...", "x,", "é,", "ﬁ", "漢字。", "1,000.", "²,", "á,", "\t", " ", "　", "\r\n", " ", "  ", "\n", "\n\n", "<|endoftext|>", "''s", "?!", "-a-", "\x1c", "_."]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(600)] + [None, "", " ", "\n", "a ", " a"]
    for most in (1 << 20, 40):
        monkeypatch.setattr(token_codes, "KNOWN_WORDS", most)
        monkeypatch.setattr(token_codes, "ENCODE_CHARS", 300)
        token_codes._ENCODERS.clear()
        for text, ids in zip(texts, token_codes.encoded(texts, tokenizer_path()), strict=True):
            assert ids.tolist() == whole_ids(text), repr(text)
    token_codes._ENCODERS.clear()


def test_new_words_reach_the_model_in_the_library_s_pieces(monkeypatch):
    """The library's own cutting of texts, most of the cost of a new word, is left to words of other characters."""
    rng = random.Random(4)
    bits = ["a", "Word", "ñé", "ß", "ǅɏ", "7", "42", "'", "'s", "'re", "'ll", "'S", "'t", "'d", "'m", "'ve", "-", "_", ".,", '"', "(", "!?", "#*"]
    words = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 6))) for _ in range(4000)] + ["don't", "dogs'", "'llama", "it's,", "x''re", "3rd"]
    texts = [" ".join(words[i : i + 7]) + "\n" + words[i] for i in range(0, len(words), 7)]
    want = [whole_ids(t) for t in texts]
    encoder = token_codes.Encoder(tokenizer_path())
    monkeypatch.setattr(encoder, "whole", lambda texts: [] if not texts else pytest.fail("encoded whole"))
    monkeypatch.setattr(encoder, "tok", None)
    assert [x.tolist() for x in encoder.ids(texts)] == want


def test_special_tokens_in_texts():
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\ny", "<|endoftext", "a <|endoftext|>  b"):
        (ids,) = token_codes.encoded([text], tokenizer_path())
        assert ids.tolist() == whole_ids(text)
    assert 50256 in whole_ids("a <|endoftext|> b")


def test_round_trip_of_documents(spark):
    rng = random.Random(8)
    rows = [(i * 3, " ".join(rng.choice(["alpha", "beta,", "Γ"]) for _ in range(rng.randint(0, 50)))) for i in range(200)] + ODD
    rng.shuffle(rows)
    got = sorted(token_codes.round_trip(spark, documents(spark, rows), tokenizer_path()).collect(), key=lambda r: r.start)
    keys = [(-1 if r.doc_id is None else r.doc_id) for r in got]
    assert keys == sorted(keys) and len(got) == len(rows)
    start, want = 0, {}
    for d, t in rows:
        ids = np.array([*whole_ids(t), 0], "<u4")
        want.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r.start == start
        assert (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        start += r.n_tokens
    assert token_codes.round_trip(spark, documents(spark, []), tokenizer_path()).count() == 0


def test_token_at(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/ids"
    token_codes.write_ids(spark, documents(spark, [(2, "c d"), (1, "a b")]), tokenizer_path(), path)
    want = [*whole_ids("a b"), 0, *whole_ids("c d"), 0]
    assert [token_codes.token_at(spark, path, i) for i in range(len(want))] == want
    with pytest.raises(IndexError):
        token_codes.token_at(spark, path, len(want))


def test_rollup_deltas_and_idempotence(spark, tmp_path):
    r = token_rollup.Rollup(spark, f"file://{tmp_path}/totals")
    assert r.totals().count() == 0
    counts = lambda rows: token_rollup.count_tokens(documents(spark, rows), "v1")
    first = counts([(1, "a b c", "x"), (2, "d", None), (3, None, "x")])
    assert r.commit("b/1", token_rollup.inserts(first)) and not r.commit("b/1", token_rollup.inserts(first))
    show = lambda: {(t.source, t.documents, t.tokens) for t in r.totals().collect()}
    assert show() == {("x", 2, 3), (None, 1, 1)}
    assert r.commit("b/2", token_rollup.revisions(counts([(1, "a b c", "x")]), counts([(1, "a b", "y")])))
    assert r.commit("b/3", token_rollup.deletes(counts([(2, "d", None)])))
    assert show() == {("x", 1, 0), ("y", 1, 2)}


def maintained(spark, rows, monkeypatch=None):
    got = token_rollup.maintained_counts(spark, documents(spark, rows), tokenizer_path()).collect()
    want: dict = {}
    first: dict = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    for d, t, *s in rows:
        if d is not None and d > first[t or ""]:
            continue
        for version, n in (("byte_bpe_50k", len(whole_ids(t))), ("words-2", len((t or "").encode().split()) + (t or "").count("\n"))):
            a, b = want.get((version, *(s or ["s"])), (0, 0))
            want[version, *(s or ["s"])] = (a + 1, b + n)
    assert {(r.tokenizer, r.source): (r.documents, r.tokens) for r in got} == want


def test_maintained_counts_against_brute_force(spark, monkeypatch):
    rows = [(1, "a b\nc", "x"), (2, "a b\nc", "y"), (3, "a b\nc", "x"), (4, None, None), (5, "", "x"), (6, "d  e", "y")]
    # A row of a deleted id with another text stays.
    rows += [(2, "other text kept", "y"), (1, "a b\nc", "x"), (None, "a b\nc", "z"), (7, "a <|endoftext|> b", "x")]
    maintained(spark, rows)
    monkeypatch.setattr(token_rollup, "HOT", 2)
    maintained(spark, rows)
    maintained(spark, [(d, t[:500] if t else t) for d, t in ODD])
    maintained(spark, [])
