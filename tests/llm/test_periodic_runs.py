"""Runs of words against all periods of all stretches."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lineweave.llm import periodic_runs as R
from lineweave.llm.queries import op12_periodic_runs


def brute(w, exponent, least):
    """All maximal stretches with smallest period q and length >= max(least, exponent * q)."""
    n, out = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in out.items())


def digest(w, runs):
    gone = set()
    for s, e, q in runs:
        gone |= set(range(s + q, e))
    best = max(runs, key=lambda r: ((r[1] - r[0]) / r[2], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(runs, key=lambda r: (r[0], r[2])))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    values = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (len(runs), *values, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def words(rng, n):
    out = []
    while len(out) < n:
        unit = [rng.randint(0, rng.choice([1, 2, 50])) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 31]))]
        k = len(unit) * rng.choice([1, 2, 3, 4, 5, 9]) + rng.randint(0, 5)
        out += (unit * k)[:k]
    return out[:n]


@pytest.mark.parametrize("exponent, least", [(2, 1), (2, 6), (3, 1), (4, 6), (7, 20)])
def test_against_all_periods(monkeypatch, exponent, least):
    rng = random.Random(exponent)
    for cells in (8, 1 << 22):
        monkeypatch.setattr(R, "CELLS", cells)
        for n in [0, 1, 2, 3, 5, 8, *(rng.randint(5, 300) for _ in range(60))]:
            w = words(rng, n)
            ids = np.array([*(x + 1 for x in w), 0])  # a separator behind
            assert R.find_runs(ids, n, min_exponent=exponent, min_length=least) == brute(w, exponent, least), w


def test_structured_words():
    """Thue-Morse, Fibonacci and powers of one word."""
    tm, fib, last = [0], [0, 1], [0]
    while len(tm) < 1024:
        tm += [1 - x for x in tm]
    while len(fib) < 900:
        fib, last = fib + last, fib
    for w in (tm, fib, [5] * 1000, ([1] * 7 + [2]) * 60, tm * 5):
        for exponent in (2, 4):
            assert R.find_runs(np.array([*(x + 1 for x in w), 0]), len(w), min_exponent=exponent, min_length=1) == brute(w, exponent, 1)


def test_long_text_of_one_word():
    n = 2_000_000
    assert R.find_runs(np.array([1] * n + [0]), n) == [(0, n, 1)]


def planted(doc, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_query_against_brute(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "GROUP_BYTES", 2000)
    rng = random.Random(4)
    rows = [(None, "a " * 9), (3, None), (3, ""), (3, " \t\n\x0b\x0c\r "), (4, "é" * 5000), (5, "x y " * 12), (6, "A a " * 8), (-7, "q " * 3000)]
    rows += [(i, " ".join(f"w{x}" for x in words(rng, rng.randint(0, 120))).replace(" ", rng.choice([" ", "\n", " \t "]))) for i in range(300)]
    rows += rows[:20]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((d, *digest(planted(d, t), brute(planted(d, t), 4, 6))) for d, t in rows), key=str)
    assert sum(planted(d, t) != planted(None, t) for d, t in rows) > 10


def test_texts_and_columns(spark):
    df = spark.createDataFrame([(1, "to be to be to be to be or not", "x", 2)], "doc_id int, text string, runs string, length int")
    row = R.periodic_runs(df, keep=("doc_id",)).collect()[0]
    assert (row.doc_id, row.n_words, row.collapsed, row.runs[0].asDict()) == (1, 10, "to be or not", {"start": 0, "length": 8, "period": 2})
    assert R.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        R.periodic_runs(df, min_exponent=1)
