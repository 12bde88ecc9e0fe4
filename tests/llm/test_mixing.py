"""Mixing: targets against an iterated reshare, taken words against targets, repeats and odd rows."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from lineweave.llm import mixing


def reshared(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1.0 + i % 3 for i, s in enumerate(order)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        target = {s: 3.0 * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def corpus(seed, sources=9, rows=400):
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        s = None if rng.random() < 0.05 else f"s{min(int(rng.expovariate(0.5)), sources)}"
        out.append((i, " \n".join(["wörd"] * int(rng.paretovariate(1.1) * 3)) if rng.random() > 0.05 else rng.choice([None, ""]), s, "x"))
    return out + out[:7] + [(None, "a b c", "s1", "y")]


def test_targets_and_takes(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
        got = mixing.mix(df).collect()
        again = mixing.mix(df.repartition(7)).collect()
        key = lambda r: (str(r.doc_id), str(r.source), r.size, r.copies)
        assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
        size, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
        for _, text, s, _ in rows:
            n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
            size[s] += n
            most[s] = max(most[s], n)
        target = reshared(dict(size))
        for r in got:
            assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
            assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
            taken[r.source] += r.taken
        for s in size:
            assert abs(taken[s] - target[s]) <= 0.5 * most[s] + 1e-6


def test_base_rates(spark):
    df = spark.createDataFrame([(i, "a " * (1 + i % 9), f"s{i % 2}") for i in range(300)], "doc_id long, text string, source string")
    got = mixing.mix(df, base=F.when(F.col("doc_id") % 5 == 0, 2.0).otherwise(0.5)).collect()
    for s in ("s0", "s1"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.rate * r.size for r in own) - own[0].target) < 1e-3
        low, high = ({r.rate for r in own if (r.doc_id % 5 == 0) == x} for x in (False, True))
        assert len(low) == len(high) == 1 and (abs(max(high) / max(low) - 4) < 1e-9 or max(high) == 3)


def test_documents_and_empty(spark):
    rows = corpus(4, rows=60)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n string")
    taken = sum(r.copies for r in mixing.mix(df).collect())
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.count() == taken
    assert mixing.mix(df.limit(0)).count() == 0


def test_small_base_rates(spark):
    rows = [(i, "a b c d", f"s{i % 2}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, base=F.when(F.col("doc_id") % 4 < 2, 0.004).otherwise(0.001)).collect()
    assert all(r.rate > 0 for r in got)
    for source in ("s0", "s1"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 8
