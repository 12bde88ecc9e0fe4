"""Top-k inner products against all scores."""

import duckdb
import numpy as np

from lineweave.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, asked, k):
    sound = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, v in sound:
        if i in asked:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in sound if j != i and len(w) == len(v))[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)}
    return out


def test_against_all_scores(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 150)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 6) / 8 if i % 3 else rng.normal(size=6)).tolist()) for i in range(700)]
    rows += [(700, None), (800, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (900, [float("nan")] * 6), (1000, [float("inf")] * 6), (1100, []), (1200, [1.0, 2.0]), (1201, [3.0, -1.0]), (1300, [0.0] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0"), k=10).select("query_id", "rank", "vec_id", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, set(range(0, 2000, 100)), 10)


def test_repeats_and_empty(spark):
    rows = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 0"), k=10).collect())
    assert got == [(0, 1, 1, 2048 * 1024), (0, 2, 1, 2048 * 1024), (0, 3, 2, 1024 * 1024)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk.top_k(df, df.limit(0)).count() == 0


def test_sql(spark):
    path = "/root/testdata/sf0.01"
    from lineweave.llm.queries import op10_topk

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/embeddings.parquet'")
    want = sorted(con.execute(topk.ORACLE).fetchall())
    assert want and sorted(tuple(r) for r in op10_topk(spark, path).select("query_id", "rank", "vec_id", "score").collect()) == want
