"""Near duplicates against all pairs, on small tables with copies, chains and one large group of edited copies."""

import random
import re

import pytest

from lineweave.llm import minhash
from lineweave.llm.graph import components


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent=80):
    sets = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [text(rng.choice([1, 2, 3, 5, 9, 30, 120])) for _ in range(60)]
    base = text(100)
    rows.append(base)
    for _ in range(60):  # each links with the original, few with one another
        w = base.split()
        for _ in range(4):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append(" ".join(w))
    chain = text(60).split()
    for _ in range(8):
        rows.append(" ".join(chain))
        chain[rng.randrange(60)] = rng.choice(vocab)
    rows += [rows[3], rows[3].upper(), rows[5] + "\n", "", None, " \t", "a b", "A\tB", "a", "one two three", "one two three four five six"]
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


def test_against_all_pairs(spark):
    for seed, k in ((1, 2), (2, 5)):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, key string")
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, words=k).collect()}
        assert got == brute(rows, k)


def test_edges(spark):
    schema = "doc_id long, text string"
    rows = [(None, "a b c"), (5, "a b c"), (5, "a b c"), (7, "A B C"), (None, None), (9, None), (9, "")]
    got = sorted(map(str, minhash.near_duplicates(spark.createDataFrame(rows, schema), words=2).collect()))
    want = [(None, 2, None, False), (5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (None, 0, None, False), (9, 0, 9, True), (9, 0, 9, True)]
    assert got == sorted(f"Row(doc_id={a}, n_shingles={b}, component_id={c}, kept={d})" for a, b, c, d in want)
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(20, 33)] + [(1, 7), (7, 1), (3, 3), (None, 2), (40, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 20 for i in range(20, 34)}, 1: 1, 7: 1, 40: 1, 3: 3}


def test_links_across_a_star(spark):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(80)]
    base = [rng.choice(vocab) for _ in range(90)]
    texts = {0: " ".join(base)}
    for i in range(1, 90):  # edits upon edits, so that distant members are near one another
        w = texts[rng.choice([0, rng.randrange(i)])].split()
        for _ in range(rng.choice([1, 3, 6])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 2])] = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2]))]
        texts[i] = " ".join(w)
    for k in (2, 5):
        sets = {i: shingle_set(t, k) for i, t in texts.items()}
        near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])  # noqa: E731,B023
        far = {i for i in texts if i and not near(i, 0)}
        stars = spark.createDataFrame([(0, i, i if i in far else 0, i in far) for i in texts if i], "leader long, member long, inside long, outside boolean")
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {(r.a, r.b) for r in minhash.across(stars, docs, k, 80).collect()}
        want = {(a, b) for a in texts for b in texts if 0 < a < b and (a in far or b in far) and near(a, b)}
        assert got == want and len(want) > 9


def test_thresholds_that_bands_cannot_hold(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
    with pytest.raises(ValueError):
        minhash.near_duplicates(df, percent=50)
    assert minhash.near_duplicates(df, percent=50, bands=40, rows=2).where("kept").count() == 1
