"""Exact substring dedup against a count of all strings."""

import hashlib
import random
from collections import Counter

import pytest

from lineweave.llm import suffix_dedup


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    times = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, small):
    rng = random.Random(seed)
    vocab = ["the", "of", "ñandú", "a"] + ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(12 if small else 300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, other = text(70), text(60)
    rows = []
    for i in range(90):
        t = text(rng.choice([0, 1, 20, 90]))
        if i % 3 == 0:  # passages with cut ends
            p = passage[rng.randint(0, 60) : len(passage) - rng.randint(0, 60)]
            t = text(rng.randint(0, 12)) + p + text(rng.randint(0, 12))
        if i % 10 == 1:
            t += other + rng.choice([" x ", ""]) + other
        rows.append((i, t))
    rows += [(200, rows[4][1]), (201, "a" * 700), (202, "xy" * 150), (203, None), (204, ""), (None, rows[0][1] + "!"), (4, rows[4][1]), (5, text(80))]
    return rows


@pytest.mark.parametrize("seed,length,many", [(1, 200, 20_000), (2, 60, 20_000), (3, 200, 3), (4, 20, 20_000)])
def test_against_all_strings(spark, monkeypatch, seed, length, many):
    monkeypatch.setattr(suffix_dedup, "NAME_ROWS", many)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    rows = corpus(seed, length < 100)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_bytes string")
    got = suffix_dedup.remove_repeats(df, length=length).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute(rows, length)


def test_empty(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
