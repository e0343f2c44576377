import hashlib
import random
from types import SimpleNamespace

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from quern.llm import bpe
from quern.llm.queries import op7_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Library.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def ours():
    with open(PATH, "rb") as f:
        raw = f.read()
    words = [b"the", b"then", b"there", b"of", b"hash", b"ash", "été".encode(), b"a", b"1"]
    t = bpe.Tokenizer(raw)
    block = bpe.compile_lexicon(dict(zip(words, t.merge(words), strict=True)))
    compute = bpe.encoder(SimpleNamespace(value=raw), SimpleNamespace(value=block))
    return lambda text: tuple(x.to_pylist()[0] for x in compute([text]))


def same(library, ours, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert ours(text) == (ids, library.decode(ids, skip_special_tokens=False))


AWKWARD = ["", " ", "\n\t ", "the", "There of ASH!!", "It's we'll I'D 'S x''ll", "ÀÉ été ŻÓŁĆ", "ΑΣ ΣΑΣ ὈΔΥΣΣΕΎΣ", "İstanbul ŉ ẞ ﬁ", "a\x1cb\x1d\x1e \x1f", "<|endoftext|>", "a<|startoftext|>B <|endoftext|>c", "<|endof text|> <|",
           "1234 ½ ² ٣ Ⅷ", "日本語 テスト 한국어", "👍🏽 👨‍👩‍👧", "a b c　d​e᠎f﻿g", "\u0000\u0007", "x" * 5000, "ab" * 4000, "!?" * 3000, "…—“”", "don't DON'T", "á̧ͅ", "ſtreet K Å"]


@pytest.mark.parametrize("text", AWKWARD)
def test_awkward_texts_match_the_library(library, ours, text):
    same(library, ours, text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8", max_codepoint=0x2FF), st.sampled_from("'stremld thΣσ́  <|endoftext|>"), st.characters(codec="utf-8", categories=["L", "N", "P", "S", "Z"]))))
def test_any_text_matches_the_library(library, ours, text):
    same(library, ours, text)


def test_long_words_are_merged_exactly_and_not_remembered(library, ours):
    rng = random.Random(8)
    for n in (130, 4000, 300_000):
        text = "the " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) + " end"
        same(library, ours, text)
    held = dict(zip(ours.__closure__[0].cell_contents.__code__.co_freevars, ours.__closure__[0].cell_contents.__closure__, strict=True))
    assert max(map(len, held["young"].cell_contents)) <= bpe.LONGEST and max(map(len, held["known"].cell_contents)) <= bpe.LONGEST


def test_batches_and_generations_match_the_library(library, monkeypatch):
    """Pieces that are new, remembered, of the older generation, long or special, in batches of several texts."""
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    monkeypatch.setattr(bpe, "GATHERED", 7)
    rng = random.Random(4)
    with open(PATH, "rb") as f:
        raw = f.read()
    t = bpe.Tokenizer(raw)
    words = [w.encode() for w in ("the", "then", "there", "them", "a", "abandon")]
    block = bpe.compile_lexicon(dict(zip(words, t.merge(words), strict=True)))
    compute = bpe.encoder(SimpleNamespace(value=raw), SimpleNamespace(value=block))
    pieces = ["The", "then,", "there", "thesis", "abandoned", "a", "<|endoftext|>x", "été!", "z" * 200, "(q)", *(f"w{k}th" for k in range(60))]
    for n in (0, 1, 5, 5, 5, 5, 5):
        texts = [" ".join(rng.choices(pieces, k=rng.choice([0, 1, 30]))) for _ in range(n)]
        expected = [library.encode(x, add_special_tokens=False).ids for x in texts]
        ids, decoded = (x.to_pylist() for x in compute(texts))
        assert ids == expected and decoded == [library.decode(x, skip_special_tokens=False) for x in expected]


def test_ways_through_the_lexicon_are_remembered():
    entries = {w: [k] for k, w in enumerate([b"abcd", b"abcde", b"abcdef", b"abx", b"b"])}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries))
    for _ in range(2):
        assert {w: lexicon.find(w) for w in entries} == entries
        assert [lexicon.find(w) for w in (b"", b"ab", b"abc", b"abcdx", b"abcdeff", b"abyz!", b"zzzzzz")] == [None] * 7
    assert lexicon.heads[b"abcd"][0] >= 0 and lexicon.heads[b"abyz"] == (-1, 0)


def test_counting_passes_words_on_after_so_many_characters(spark, monkeypatch):
    df = spark.createDataFrame([("the end " * 50 + "x" * 500,)] * 40, "text string")
    with open(PATH, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())
    monkeypatch.setattr(bpe, "HELD", 1000)
    assert {bytes(r.word): r.n for r in bpe.count_words(df, file).collect()} == {b"the": 2000, b"end": 2000}


def test_lexicon_is_minimal_and_exact():
    random.seed(3)
    words = {bytes(random.choices(b"abc", k=random.randint(1, 7))) for _ in range(400)}
    entries = {w: [k, k + 1] if k % 3 else [] for k, w in enumerate(sorted(words))}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries))
    for w in entries:
        assert lexicon.find(w) == entries[w]
    for _ in range(2000):
        w = bytes(random.choices(b"abcd", k=random.randint(0, 8)))
        assert lexicon.find(w) == entries.get(w)
    suffixes = {frozenset(w[len(p):] for w in words if w.startswith(p)) for x in words for p in (x[:k] for k in range(len(x) + 1))}
    assert len(lexicon.accepts) == len(suffixes)  # one state for each different set of endings
    assert bpe.Lexicon(bpe.compile_lexicon({})).find(b"a") is None


def test_query_matches_the_library(spark, library):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op7_bpe(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r.text, add_special_tokens=False).ids
        g = got[r.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (3, "the end", "z"), (3, "the end", "z")], "doc_id long, text string, ids string")
    rows = bpe.encode(df, PATH).collect()
    assert sorted(len(r.ids) for r in rows) == [0, 0, 2, 2]
    assert sorted(r.decoded for r in rows) == ["", "", "the</w> end</w>", "the</w> end</w>"]
    assert bpe.encode(df.where("false"), PATH).count() == 0
