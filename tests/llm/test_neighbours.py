"""Nearest neighbours found, against all inner products."""

from collections import Counter

import numpy as np
import pytest

from lineweave.llm import neighbours as N
from lineweave.llm.queries import op11_neighbours

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def brute(rows, asked, k):
    sound = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, v in sound:
        if i in asked:
            scores = sorted((-float((v * w).sum()), j) for j, w in sound if j != i and len(w) == len(v))[:k]
            out |= {(i, r, j, round(-s, 9)) for r, (s, j) in enumerate(scores, 1)}
    return out


def rows_of(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = [(i, (centres[rng.integers(12)] * rng.uniform(0.2, 3) + rng.normal(size=dim)).round(3).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(60)]  # copies of one vector
    rows += [rows[3]] * 2 + [rows[40]]  # repeated rows
    return rows + [(n + 100, None), (n + 120, [1.0, None] + [0.0] * (dim - 2)), (n + 140, [float("nan")] * dim), (n + 160, [float("inf")] * dim), (n + 180, []), (n + 200, [0.0] * dim), (None, [1.0] * dim), (n + 220, [1.0, 2.0]), (n + 221, [3.0, -1.0])]


@pytest.mark.parametrize("shard_rows", [10_000, 300])
def test_recall_and_scores(spark, shard_rows):
    rows = rows_of(5, 1500, 8)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    asked = set(range(0, 3000, 20))
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in N.nearest(df, df.where("vec_id % 20 = 0"), k=20, shard_rows=shard_rows).collect()]
    want = brute(rows, asked, 20)
    assert len(got) == len(want)  # whole lists
    scores = {(q, r): s for q, r, _, s in want}
    assert all(s <= scores[q, r] + 1e-9 for q, r, _, s in got)
    assert sum(s == scores[q, r] for q, r, _, s in got) >= 0.97 * len(want)
    assert Counter((q, v) for q, _, v, _ in got)[20, 3] <= 3 and all(q != v for q, _, v, _ in got)
    assert {x for x in got if x[0] == 1720} == {(1720, 1, 1721, 1.0)}


def test_few_vectors_are_whole(spark):
    rows = rows_of(7, 30, 4)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in N.nearest(df, df.where("vec_id % 20 = 0"), k=200).collect()}
    assert got == brute(rows, set(range(0, 400, 20)), 200)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(0, [1.0, 2.0], "x", 1)], SCHEMA)
    assert N.nearest(df, df).count() == 0 and N.nearest(one, df).count() == 0 and N.nearest(one, one).count() == 0 and N.nearest(df, one).count() == 0


def test_links_are_sound():
    rng = np.random.default_rng(2)
    data = rng.normal(size=(700, 6)).astype(np.float32)
    graph = N.build_graph(data / np.linalg.norm(data, axis=1)[:, None], 3, 6, 24)
    assert len(graph.links) > 1
    for level in graph.links:
        for i, row in enumerate(level):
            some = row[row >= 0].tolist()
            assert i not in some and len(some) == len(set(some))
    assert (graph.links[0] >= 0).any(1).all()


def test_query_recall(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = brute(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 20)
    got = {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in op11_neighbours(spark, path).collect()}
    assert len(got) == len(want) and len({x[::2] for x in got} & {x[::2] for x in want}) >= 0.95 * len(want)
