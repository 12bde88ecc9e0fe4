"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, shard results merged.

Distinct vectors are dealt to shards by hash. Each shard becomes one row: its vectors and, for every level, the
neighbours of its nodes in one flat array. The index is written to the shared folder, so that a lost executor costs a
re-read. Queries are dealt to all shards in blocks (a stated query set against all rows) and walk the graph in step, one
expansion of every query at a time; each shard's best are merged by a window for each query.

Inner products become distances by one more component that gives all vectors of a shard one length; the graph is built on
those, and queries have a zero there. Copies of one vector are one node, which carries as many of their ids, smallest
first, as a result can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm._shared import over_arrow, stored

#: Vectors of a shard, about; neighbours of a node above level 0 (twice as many there).
SHARD_ROWS, NEIGHBOURS = 4096, 16
#: Candidates kept while a node is linked, and while a query walks.
BUILD_WIDTH, SEARCH_WIDTH = 48, 96
#: Nodes linked at a time, at most a quarter of those that are there; queries that walk at a time.
LINKED, WALKING = 256, 256
#: Queries of a block, and the blocks from which on a shard goes to more than one task.
QUERY_ROWS, BLOCKS = 512, 64


class Graph:
    """Flat neighbour arrays of one shard: ``links[level]`` has a row for each node (-1: none)."""

    def __init__(self, data: np.ndarray, links: list[np.ndarray], entry: int):
        self.data, self.links, self.entry = data, links, entry

    def walk(self, queries: np.ndarray, level: int, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best nodes found for each query (rows), best first, with their inner products; -1 where fewer."""
        n, rows = len(self.data), np.arange(len(queries))
        links = self.links[level]
        seen = np.zeros((len(queries), n), bool)
        ids = np.full((len(queries), width), -1, np.int64)
        near = np.full((len(queries), width), -np.inf, np.float32)
        tried = np.zeros((len(queries), width), bool)
        first = starts.shape[1]
        ids[:, :first] = starts
        near[:, :first] = np.where(starts >= 0, np.einsum("qkd,qd->qk", self.data[starts], queries), -np.inf)
        np.put_along_axis(seen, np.maximum(starts, 0), True, 1)
        going = rows
        while len(going):
            open_ = np.where(tried[going] | (ids[going] < 0), -np.inf, near[going])
            at = open_.argmax(1)
            alive = open_[np.arange(len(going)), at] > -np.inf  # the best untried one is among the width best
            going, at = going[alive], at[alive]
            if not len(going):
                break
            tried[going, at] = True
            met = links[ids[going, at]]
            fresh = (met >= 0) & ~seen[going[:, None], met]
            seen[going[:, None], np.where(fresh, met, ids[going, at][:, None])] = True
            some = fresh.any(1)
            rows_, met, fresh = going[some], met[some], fresh[some]
            if not len(rows_):
                continue
            value = np.full(met.shape, -np.inf, np.float32)
            r, c = np.nonzero(fresh)
            value[r, c] = np.einsum("nd,nd->n", self.data[met[r, c]], queries[rows_[r]])
            value[value <= near[rows_].min(1)[:, None]] = -np.inf
            better = (value > -np.inf).any(1)
            rows_, met, value = rows_[better], met[better], value[better]
            if not len(rows_):
                continue
            near_ = np.concatenate([near[rows_], value], 1)
            best = np.argpartition(-near_, width - 1, axis=1)[:, :width]
            take = lambda x: np.take_along_axis(x, best, 1)
            near[rows_] = take(near_)
            ids[rows_] = np.where(near[rows_] > -np.inf, take(np.concatenate([ids[rows_], met], 1)), -1)
            tried[rows_] = take(np.concatenate([tried[rows_], np.zeros(met.shape, bool)], 1))
        order = np.argsort(-near, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full((len(queries), 1), self.entry)
        for level in reversed(range(1, len(self.links))):
            at = self.walk(queries, level, at, 1)[0]
        return self.walk(queries, 0, at, width)


def _diverse(data: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's candidates (best first), those nearer to a chosen one than to the node behind the rest."""
    rows, width = ids.shape
    some = np.where(ids >= 0, ids, 0)
    mutual = data[some] @ data[some].transpose(0, 2, 1)
    chosen = np.zeros((rows, width), bool)
    for i in range(width):
        hidden = (chosen & (mutual[:, i] > near[:, i, None])).any(1)
        chosen[:, i] = ~hidden & (ids[:, i] >= 0) & (chosen.sum(1) < most)
    order = np.argsort(~chosen, axis=1, kind="stable")[:, :most]  # chosen first, then the nearest others
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def build_graph(data: np.ndarray, seed: int, neighbours: int, width: int) -> Graph:
    """The graph of distinct vectors of one length. Nodes come in a few at a time; those of one step also see one another."""
    n = len(data)
    rng = np.random.default_rng(seed)
    levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(neighbours)).astype(int), 6)
    top = int(levels.max(initial=0))
    links = [np.full((n, neighbours * (1 if level else 2)), -1, np.int32) for level in range(top + 1)]
    order = np.lexsort((rng.random(n), -levels))  # higher levels first: upper graphs are whole before they are walked
    graph = Graph(data, links, int(order[0]) if n else -1)
    done = min(n, 1)
    while done < n:
        new = order[done : done + max(1, min(LINKED, done // 4))]
        at = np.full((len(new), 1), graph.entry)
        for level in range(top, -1, -1):
            here = levels[new] >= level
            wide = np.full((len(new), width), -1, np.int64)
            near = np.full((len(new), width), -np.inf, np.float32)
            for group, w in ((here, width), (~here, 1)):
                if group.any():
                    wide[group, :w], near[group, :w] = graph.walk(data[new[group]], level, at[group], w)
            at = wide[:, :1]
            if here.any():
                _link(data, links[level], new[here], wide[here], near[here])
        done += len(new)
    return graph


def _link(data: np.ndarray, links: np.ndarray, new: np.ndarray, ids: np.ndarray, near: np.ndarray) -> None:
    """Links ``new`` nodes with the best of what they have found and of one another, and those back."""
    among = data[new] @ data[new].T
    np.fill_diagonal(among, -np.inf)
    ids = np.concatenate([ids, np.broadcast_to(new, among.shape)], 1)
    near = np.concatenate([near, among], 1)
    order = np.argsort(-near, axis=1, kind="stable")[:, : links.shape[1] * 2]
    near = np.take_along_axis(near, order, 1)
    ids = np.where(near > -np.inf, np.take_along_axis(ids, order, 1), -1)
    ids = _diverse(data, ids, near, links.shape[1])
    links[new] = ids
    a, b = np.repeat(new, ids.shape[1]), ids.ravel()
    a, b = a[b >= 0], b[b >= 0]
    by = np.argsort(b, kind="stable")
    a, b = a[by], b[by]
    targets, begins, sizes = np.unique(b, return_index=True, return_counts=True)
    slot = np.arange(len(b)) - np.repeat(begins, sizes)
    back = np.full((len(targets), int(sizes.max(initial=0))), -1, np.int64)
    back[np.repeat(np.arange(len(targets)), sizes), slot] = a
    both = np.concatenate([links[targets], back], 1)
    twice = np.zeros(both.shape, bool)
    ordered = np.sort(both, axis=1)
    if (ordered[:, 1:] == ordered[:, :-1])[ordered[:, 1:] >= 0].any():  # linked from both sides in one step
        for i in range(both.shape[1] - 1, 0, -1):
            twice[:, i] = (both[:, :i] == both[:, i : i + 1]).any(1)
    both = np.where(twice, -1, both)
    near = np.where(both >= 0, (data[both] @ data[targets][:, :, None])[:, :, 0], -np.inf)
    order = np.argsort(-near, axis=1, kind="stable")
    near, both = np.take_along_axis(near, order, 1), np.take_along_axis(both, order, 1)
    full = (both >= 0).sum(1) > links.shape[1]
    kept = both[:, : links.shape[1]].copy()
    if full.any():
        kept[full] = _diverse(data, both[full], near[full], links.shape[1])
    links[targets] = np.pad(kept, ((0, 0), (0, links.shape[1] - kept.shape[1])), constant_values=-1)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array<float>): rows with an id whose vector is neither null, empty or zero nor holds null or non-finite components."""
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector_col, lambda x: x != 0)
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v"))


def build_index(df: DataFrame, *, ids_kept: int = 21, shard_rows: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each shard: dim, shard, data, links (by level), entry, and for each node sizes, ids and times.

    Every vector is indexed, in the shard of its hash and length. A node's ``ids`` are the ``ids_kept`` smallest ones of its
    vector, ``sizes`` their number, and ``times`` the number of rows of each.
    """
    rows = whole_vectors(df, id_col, vector_col).groupBy("v", "vec_id").agg(F.count("*").alias("n"))
    # a vector of very many copies: the window keeps its smallest ids before the shuffle, as it is cut by its rank
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= ids_kept)
    nodes = stored(first.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("members")), "distinct-vectors")
    shards = max(1, -(-nodes.count() // (shard_rows or SHARD_ROWS)))
    dealt = nodes.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard"), "v", "members")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        dim, shard = (k.as_py() for k in key)
        data = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        members = table.column("members").combine_chunks()
        order = np.lexsort(data.T[::-1])  # however the rows came in, the graph is the same
        data, members = np.ascontiguousarray(data[order]), members.take(pa.array(order))
        square = np.einsum("id,id->i", data, data, dtype=np.float64)
        longer = np.sqrt(np.maximum(square.max() - square, 0)).astype(np.float32)
        graph = build_graph(np.concatenate([data, longer[:, None]], 1), shard, NEIGHBOURS, BUILD_WIDTH)
        flat = members.flatten()
        out = {
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int64()), "data": pa.array([data.tobytes()], pa.binary()),
            "links": pa.array([[level.tobytes() for level in graph.links]], pa.list_(pa.binary())), "entry": pa.array([graph.entry], pa.int64()),
            "sizes": pa.array([members.value_lengths().to_numpy().astype(np.int32).tobytes()], pa.binary()),
            "ids": pa.array([flat.field("vec_id").to_numpy().tobytes()], pa.binary()), "times": pa.array([flat.field("n").to_numpy().tobytes()], pa.binary()),
        }
        return pa.table(out)

    schema = "dim int, shard long, data binary, links array<binary>, entry long, sizes binary, ids binary, times binary"
    return stored(dealt.repartition(2 * shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, schema), "shards")


def nearest(df: DataFrame, queries: DataFrame, *, k: int = 20, width: int | None = None, shard_rows: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``df`` found with the largest inner products for each row of ``queries``, nearly all of the true ones.

    Returns ``query_id``, ``rank`` (int, from 1), ``vec_id``, ``score`` (double: the inner product of the original vectors),
    best first, ties to the smaller ``vec_id``. Both tables have ``id_col`` and ``vector_col``.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id.
    Vectors meet those of their own length. Rows with the query's id are its own and left out; repeated candidates count
    each, repeated queries once. Fewer than k candidates: all that are found. Empty tables give none. Other columns are
    not read. ``width`` >= k candidates are kept on a walk.
    """
    width = max(width or SEARCH_WIDTH, k + 1)
    index = build_index(df, ids_kept=k + 1, shard_rows=shard_rows, id_col=id_col, vector_col=vector_col)
    asked = whole_vectors(queries, id_col, vector_col).dropDuplicates().select(F.size("v").alias("dim"), "vec_id", "v")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat, ends = batch.column(2).flatten().to_numpy(), np.cumsum(batch.column(2).value_lengths().to_numpy())
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                data = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                for i in range(0, len(at), QUERY_ROWS):
                    part = slice(i, i + QUERY_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[at[part]].tobytes()]), pa.array([data[part].tobytes()])], names=["dim", "qids", "qdata"])

    # few partitions make whole blocks; each block goes to every shard, and many blocks to several copies of it
    shards = index.agg(F.max("shard")).first()[0]
    some = -(-asked.count() // QUERY_ROWS)
    parts, tasks = max(1, some // BLOCKS), 2 * ((shards or 0) + 1)
    blocks = over_arrow(asked.repartition(max(1, min(some, 64 * parts)), F.xxhash64("vec_id", "v")), packed, "dim int, qids binary, qdata binary")
    at = ["dim", "shard", "part"]
    sent = blocks.withColumn("part", F.pmod(F.xxhash64("qids"), F.lit(parts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards or 0).cast("long"))))
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = copies.repartition(tasks * parts, *at).join(sent.repartition(tasks * parts, *at), at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _found(row, k, width)

    columns = ["dim", "data", "links", "entry", "sizes", "ids", "times", "qids", "qdata"]
    hits = over_arrow(met.select(*columns), run, "query_id long, at long, vec_id long, score double, n long")
    rank = Window.partitionBy("query_id", "at").orderBy(F.col("score").desc(), "vec_id")
    each = hits.withColumn("i", F.row_number().over(rank)).where(F.col("i") <= k)
    each = each.select("query_id", "at", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))
    return each.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(row: dict, k: int, width: int) -> pa.RecordBatch:
    """The k best of one shard for one block of queries. ``at`` tells vectors of one query id apart."""
    dim = row["dim"]
    data = np.frombuffer(row["data"], np.float32).reshape(-1, dim)
    links = [np.frombuffer(x, np.int32).reshape(len(data), -1) for x in row["links"]]
    sizes, ids, times = (np.frombuffer(row[c], t) for c, t in (("sizes", np.int32), ("ids", np.int64), ("times", np.int64)))
    begins = np.cumsum(sizes) - sizes
    graph = Graph(data, links, row["entry"])
    qids = np.frombuffer(row["qids"], np.int64)
    asked = np.frombuffer(row["qdata"], np.float32).reshape(-1, dim)
    out: list[list] = [[], [], [], [], []]
    for i in range(0, len(qids), WALKING):
        nodes = graph.search(asked[i : i + WALKING], width)[0]
        for own, q, hit in zip(qids[i : i + WALKING].tolist(), asked[i : i + WALKING], nodes):
            hit = hit[hit >= 0]
            score = (data[hit].astype(np.float64) * q.astype(np.float64)).sum(1)
            best = np.argsort(-score, kind="stable")
            best = best[score[best] >= score[best[: k + 1]].min(initial=np.inf)]  # one of them may be the query's own; ties stay
            some = np.repeat(hit[best], sizes[hit[best]])
            slot = np.arange(len(some)) - np.repeat(np.cumsum(sizes[hit[best]]) - sizes[hit[best]], sizes[hit[best]])
            member = begins[some] + slot
            value = np.repeat(score[best], sizes[hit[best]])
            other = ids[member] != own
            member, value = member[other], value[other]
            keep = np.lexsort((ids[member], -value))[:k]
            at = crc32(q.tobytes())
            for column, part in zip(out, ([own] * len(keep), [at] * len(keep), ids[member[keep]].tolist(), value[keep].tolist(), times[member[keep]].tolist())):
                column += part
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["query_id", "at", "vec_id", "score", "n"])
