"""Collocations against counts of every phrase."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from lineweave.llm import collocations as C

SCHEMA = "lang string, text string, phrase string, a string"


def brute(rows, low, high, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + m]) for m in range(1, high + 1) for i in range(len(w) - m + 1))
    out = set()
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if low <= len(p) and a >= least}
        rows_ = []
        for p, a in some.items():
            score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if not any(len(q) > len(p) and inside(q) and 100 * b >= share * a for q, b in some.items()):
                rows_.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.add((lang, i, p.decode(), -a, left, right, n[lang], -s))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["The", "of", "ñu", "ÉA", "a", "b c", "zz"] + [f"w{i}" for i in range(40)]
    rows = [(None, None), ("en", ""), ("fr", "  \t . ,,"), ("fr", "one"), ("en", "x" * 3000), ("en", "hot pair " * 400), ("und", "a b. a b; a b")]
    for i in range(250):
        pick = [rng.choice(words[: rng.choice([3, 10, 47])]) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!? "]) for w in pick)
        rows.append((rng.choice(["en", "en", "de", None, "xx"]), text))
    return rows + rows[-30:]


@pytest.mark.parametrize("low, high, least, share", [(2, 3, 10, 50), (2, 2, 4, 50), (3, 4, 3, 60), (2, 4, 3, 100)])
def test_against_all_phrases(spark, monkeypatch, low, high, least, share):
    monkeypatch.setattr(C, "FOLLOWED", 3)
    rows = corpus(high)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in C.collocations(df, min_words=low, max_words=high, min_count=least, share=share, top=60).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    want = brute(rows, low, high, least, share, 60)
    assert len(got) == len(want) > 50 and set(got) == want


@pytest.mark.parametrize("words", [2, 3, 4])
def test_bursts_and_spills(monkeypatch, words):
    """Tiny containers, tries, chunks and vocabularies: partial counts still add up."""
    for name, value in {"BURST": 4, "ENTRIES": 60, "CHUNK": 50, "VOCABULARY_BYTES": 150, "TRIES": 2}.items():
        monkeypatch.setattr(C, name, value)
    rows = corpus(9)
    got, runs = Counter(), 0
    held = C.PhraseCounts(words, [("en", b"the", b"of")])
    batches = [b for lang, t in rows for b in held.text(lang or "und", (t or "").encode())] + list(held.close())
    for batch in batches:
        part = batch.to_pylist()
        runs += 1
        if len(part) > 1 and part[0]["split"] >= 0:
            keys = [(r["prefix"].split(" "), r.get("w3"), r.get("w4")) for r in part]
            assert keys == sorted(keys)
        for r in part:
            if r["split"] == C.FIRST:
                got[r["lang"], r["prefix"]] += r["a"]
            else:
                phrase = r["prefix"].split(" ") + [w for w in (r.get("w3"), r.get("w4")) if w]
                for m in range(2, len(phrase) + 1):
                    got[r["lang"], " ".join(phrase[:m])] += r["a"]
    want = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            want[lang or "und", ""] += len(w)
            want.update((lang or "und", " ".join(w[i : i + m])) for m in range(1, words + 1) for i in range(len(w) - m + 1))
    assert runs > 50 and +got == +want


def test_trie_bursts_into_words():
    trie = C.HatTrie(3, 21)
    import numpy as np

    keys = np.array(sorted(5 << 42 | b << 21 | c for b in range(300) for c in range(300)))
    trie.add(keys, np.ones(len(keys), int))
    trie.add(keys[::2], np.ones(len(keys[::2]), int))
    assert any(isinstance(k, C.Node) for k in trie.root.kids) and max(map(len, trie.root.parts())) <= C.BURST
    out, counts = trie.spill(0)
    assert trie.entries == 0 and sorted(out.tolist()) == keys.tolist() and counts.sum() == 135_000


def test_empty_and_refused(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.collocations(df).count() == 0
    with pytest.raises(ValueError):
        C.collocations(df, max_words=5)


def test_sql(spark):
    from lineweave.llm.queries import op13_collocations

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet'")
    want = sorted(con.execute(C.ORACLE).fetchall())
    got = op13_collocations(spark, path).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert want and sorted(tuple(r) for r in got) == want
