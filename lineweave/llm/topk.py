"""Exact top-k inner products by Fagin's threshold algorithm over sorted lists.

Vectors become blocks of at most ``BLOCK_ROWS``; each block carries, for every dimension, its rows in sorted order. A
query walks all lists of a block at once, from the end that its sign favours, scores the rows it meets and stops when
no unmet row can reach its kth score: the bound is the inner product of the query with the values where the lists
stand. Every block is met by every block of queries (a stated query set against all rows, in blocks); the blocks' best
are merged by a window for each query.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm._shared import over_arrow, stored

BLOCK_ROWS = 8192
QUERY_ROWS = 1024
SCALE = 1024


def whole_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: array<long> of floor(1024 * x), x as double. Vectors null, empty, or with null or non-finite components go."""
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return df.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & sound).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v"))


def packed(vectors: DataFrame, rows: int, lists: bool) -> DataFrame:
    """Blocks of one partition's vectors of one dimension: dim, ids, data (int64, row-major), lists (int32, by dimension)."""

    def block(dim: int, parts: list) -> pa.RecordBatch:
        ids = np.concatenate([p[0] for p in parts])
        data = np.concatenate([p[1] for p in parts])
        order = np.argsort(data, axis=0, kind="stable").T.astype(np.int32) if lists else np.empty(0, np.int32)
        cols = [pa.array([dim]), pa.array([ids.tobytes()]), pa.array([data.tobytes()]), pa.array([order.tobytes()])]
        return pa.RecordBatch.from_arrays(cols, names=["dim", "ids", "data", "lists"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list] = defaultdict(list)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sizes = batch.column(1).value_lengths().to_numpy()
            flat = batch.column(1).flatten().to_numpy()
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                data = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                open_[dim].append((ids[at], data))
                if sum(len(p[0]) for p in open_[dim]) >= rows:
                    yield block(dim, open_.pop(dim))
        for dim, parts in open_.items():
            yield block(dim, parts)

    return over_arrow(vectors, run, "dim long, ids binary, data binary, lists binary")


def threshold_search(q: np.ndarray, own: int, ids: np.ndarray, data: np.ndarray, lists: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best rows of a block for ``q``, rows with the query's id left out; ties to smaller ids."""
    dims = np.flatnonzero(q)
    n = len(ids)
    best_score, best_id = np.empty(0, np.int64), np.empty(0, np.int64)
    seen = np.zeros(n, bool)
    up = q[dims] > 0
    at, step = 0, 16

    def walked(i: int, j: int) -> np.ndarray:
        """Rows at positions i to j of each list, from the end that the query favours; no other part is read."""
        return np.concatenate([lists[dims[up], max(0, n - j) : n - i], lists[dims[~up], i:j]])

    while at < n:
        if len(dims):
            met = walked(at, at + step).ravel()
            met = np.unique(met[~seen[met]])
        else:  # every row scores 0
            met = np.arange(n)
        seen[met] = True
        met = met[ids[met] != own]
        best_score = np.concatenate([best_score, data[met] @ q])
        best_id = np.concatenate([best_id, ids[met]])
        keep = np.lexsort((best_id, -best_score))[:k]
        best_score, best_id = best_score[keep], best_id[keep]
        at += step
        step *= 2
        if not len(dims) or at >= n:
            break
        sides = np.concatenate([dims[up], dims[~up]])
        bound = int(data[walked(at - 1, at).ravel(), sides] @ q[sides])
        if len(keep) == k and best_score[-1] > bound:  # an unmet row with the bound itself might have a smaller id
            break
    return list(zip(best_score.tolist(), best_id.tolist()))


def top_k(df: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of ``df`` with the largest integer inner products for each row of ``queries``.

    Returns ``query_id``, ``rank`` (int, from 1), ``vec_id``, ``score``; ties to the smaller ``vec_id``. Both tables
    have ``id_col`` and ``vector_col``; components become floor(1024 * x). Scores must fit 64 bits.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without an id.
    Vectors meet vectors of their own length. Rows with the query's id are its own and left out. Repeated candidates
    count each; repeated queries count once. Fewer than k candidates: all. Empty tables give none. Other columns are
    not read.
    """
    blocks = packed(whole_vectors(df, id_col, vector_col).where("vec_id is not null"), BLOCK_ROWS, True)
    asked = stored(whole_vectors(queries, id_col, vector_col).where("vec_id is not null").dropDuplicates(), "queries")
    groups = max(1, -(-asked.count() // QUERY_ROWS))
    grouped = packed(asked.repartition(groups, F.xxhash64("vec_id", "v")), QUERY_ROWS, False).select("dim", F.col("ids").alias("qids"), F.col("data").alias("qdata"))
    # query blocks are numbered, and each block of rows goes once to each number of its dimension
    numbered = stored(grouped.withColumn("block", F.xxhash64("qids", "qdata").bitwiseAND((1 << 42) - 1)), "query-blocks")
    wanted = numbered.groupBy("dim").agg(F.collect_list("block").alias("blocks"))
    met = blocks.join(wanted, "dim").select("dim", "ids", "data", "lists", F.explode("blocks").alias("block")).join(numbered, ["dim", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, number, ids, data, lists, qids, qdata in zip(*(batch.column(i).to_pylist() for i in range(7))):
                ids, qids = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64)
                data, qdata = (np.frombuffer(x, np.int64).reshape(-1, dim) for x in (data, qdata))
                lists = np.frombuffer(lists, np.int32).reshape(dim, -1)
                out = [(own, number << 20 | i, *hit) for i, (own, q) in enumerate(zip(qids.tolist(), qdata)) for hit in threshold_search(q, own, ids, data, lists, k)]
                cols = list(zip(*out)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "at", "score", "vec_id"])

    hits = over_arrow(met.select("dim", "block", "ids", "data", "lists", "qids", "qdata"), run, "query_id long, at long, score long, vec_id long")
    rank = F.row_number().over(Window.partitionBy("query_id", "at").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
), p as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e)
  where q.vec_id % 100 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
  from p
)
select query_id, rank, vec_id, score from r where rank <= 10
"""
