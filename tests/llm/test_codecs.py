"""BPE against the tokenizers library, word pieces against a brute-force matcher."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lineweave.llm import bpe, token_counts
from lineweave.llm.queries import vocabulary

ODD = ["", " ", "  \n\t x", "a<|endoftext|>b <|endoftext|>", "don't I'LL we've 12345 ½ ñandú 日本語 🙂🙂", "x" * 5000, "ab" * 3000 + " .", "   y\x1c\x1d z\x85", "é" * 700, "a\x00b"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    return bpe.BytePairCodec(bpe.read_vocabulary(vocabulary("byte_bpe_50k.json")))


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text, codec, library):
    want = library.encode(text, add_special_tokens=False).ids
    got = codec.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert codec.decode(got).decode() == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn")), max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer

    lib = test_any_text.__dict__.setdefault("lib", Tokenizer.from_file(vocabulary("byte_bpe_50k.json")))
    own = test_any_text.__dict__.setdefault("own", bpe.BytePairCodec(bpe.read_vocabulary(vocabulary("byte_bpe_50k.json"))))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_heap_equals_scan(codec):
    rng = random.Random(5)
    for _ in range(200):
        word = "".join(rng.choice("abcdeth ") for _ in range(rng.randint(1, 120))).encode()
        ids = [codec.byte_ids[b] for b in word]
        assert codec.heap(list(ids)) == codec.scan(list(ids))


def test_bpe_query(spark, library):
    rows = [(i, t, "z", 7) for i, t in enumerate(ODD)] + [(None, None, "z", 7), (1, "again", "z", 7), (1, "again", "z", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")
    got = bpe.bpe_encode(df, vocabulary("byte_bpe_50k.json")).collect()
    assert len(got) == len(rows)
    texts = {(r[0], r[1] or "") for r in rows}
    for r in got:
        ids = np.array(r.ids, "<u4").tobytes()
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
        assert (r.doc_id, r.decoded) in texts and r.ids == library.encode(r.decoded, add_special_tokens=False).ids
    back = bpe.bpe_decode(bpe.bpe_encode(df, vocabulary("byte_bpe_50k.json")), vocabulary("byte_bpe_50k.json"))
    assert {(r.doc_id, r.decoded) for r in back.collect()} == texts
    assert bpe.bpe_encode(df.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def greedy(word, first, rest):
    n, at = 0, 0
    while at < len(word):
        pool = rest if at else first
        for to in range(len(word), at, -1):
            if word[at:to] in pool:
                at, n = to, n + 1
                break
        else:
            return -1
    return n


@settings(max_examples=400, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=8), st.sets(st.text("abc", min_size=1, max_size=5), max_size=8), st.lists(st.text("abcd", max_size=12), max_size=12))
def test_automaton(first, rest, words):
    counter = token_counts.PieceCounter(first, rest)
    for w in words:
        assert counter[w] == greedy(w, first, rest)


def test_token_counts_query(spark):
    first, rest = token_counts.split_byte_vocabulary(vocabulary("byte_bpe_50k.tiktoken"))
    rows = [(1, "The nation\tsaw\n unbelievable ñandúes", 3), (2, None, 1), (None, "", 1), (3, " \n", 1), (1, "x" * 2000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = sorted((r.doc_id or -1, r.n_words, r.n_tokens, r.n_unknown) for r in token_counts.token_counts(df, first, rest).collect())
    f, s = set(first), set(rest)
    want = sorted((i or -1, len(ws := (t or "").encode().split()), sum(greedy(b" " + w, f, s) for w in ws), 0) for i, t, _ in rows)
    assert got == want
    few = token_counts.token_counts(df, [b" a"], [b"b"]).collect()
    assert all(r.n_tokens == r.n_words == r.n_unknown for r in few)
