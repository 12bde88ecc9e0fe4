"""Fingerprints: exact edited texts, equal texts, likeness against generalised Jaccard similarity."""

import hashlib
import random
import re
from collections import Counter

from lineweave.llm import fingerprints


def jaccard(x, y):
    a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in (x, y))
    top = sum((a | b).values())
    return sum((a & b).values()) / top if top else 1.0


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(text, edited), jaccard(text, after))
    return out


def test_against_brute(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdeéñß日") for _ in range(rng.randint(1, 6))) for _ in range(900)]
    rows = [(3 * i * i + rng.randint(0, 3), " ".join(rng.choice(vocab[: rng.choice([20, 900])]) for _ in range(rng.choice([0, 1, 4, 200, 800])))) for i in range(300)]
    rows = list({i: (i, t) for i, t in rows}.values())
    rows += [(-5, None), (-6, " \t"), (-7, "🙂" * 10), (10**15, rows[40][1]), (10**15 + 1, rows[40][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")
    want = expected(rows)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(df).collect()}
    assert len(got) == len(rows)
    errors = []
    by_text = {}
    for i, text in rows:
        n, sha, near, after = want[i]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert by_text.setdefault(text or "", r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        errors += [r.near_edited - near, r.near_next - after]
        assert (r.fingerprint == r.edited_fingerprint) <= (r.near_edited == 1)
    assert abs(sum(errors) / len(errors)) < 0.03
    assert sum(e * e for e in errors) / len(errors) < 0.08**2


def test_edges(spark):
    schema = "doc_id long, text string"
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(7, "abc def")], schema)).collect()
    assert [(r.doc_id, r.n_chars, r.near_next, r.edited_sha256) for r in one] == [(7, 7, 1.0, hashlib.sha256(b"abc dab").hexdigest())]
    rows = [(None, "a b"), (3, None), (3, "a b"), (3, "a b"), (None, "a b")]
    got = fingerprints.fingerprint_documents(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == [("3", 0), ("3", 3), ("3", 3), ("None", 3), ("None", 3)]
    assert fingerprints.fingerprint_documents(spark.createDataFrame([], schema)).count() == 0


def test_skewed_counts(spark):
    rng = random.Random(8)
    often = ["the", "of", "and", "a"]
    rows = [(i, " ".join(["w"] * 1000 + [f"x{i}_{j}" for j in range(100)])) for i in range(40)]
    rows += [(i, " ".join(rng.choice(often) if rng.random() < 0.7 else f"y{i}_{j}" for j in range(3000))) for i in range(100, 130)]
    rows += [(i, " ".join(rng.choice("abcdefgh"[: 1 + i % 8]) for _ in range(700))) for i in range(200, 230)]
    want = expected(rows)
    got = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    errors = [e for r in got for e in (r.near_edited - want[r.doc_id][2], r.near_next - want[r.doc_id][3])]
    assert len(errors) == 200 and max(map(abs, errors)) < 0.27
    assert abs(sum(errors) / len(errors)) < 0.03
    assert sum(e * e for e in errors) / len(errors) < 0.08**2


def test_skipped_draws_change_nothing(spark, monkeypatch):
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(vocab[: rng.choice([3, 400])]) for _ in range(rng.choice([1, 2, 30, 900])))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(fingerprints.fingerprint_documents(df).collect())
    monkeypatch.setattr(fingerprints, "SURE", float("inf"))
    assert got == sorted(fingerprints.fingerprint_documents(df).collect())
