"""Near-duplicate documents by HyperMinHash: compressed registers, banding, corrected estimates, confirmation.

A document is the set of its word shingles. The hash range is dealt into ``bands * rows`` buckets; a register holds, for
the least hash of its bucket, the count of leading zeros and ``MANTISSA`` bits after them (16 bits in all). Empty
registers borrow from the first filled bucket of a fixed permutation, so small sets band as large ones do.

Documents with equal sets form one class and one representative enters the search, so copies never meet pairwise. In
each bucket of a band, members are compared with a leader, the member that most other documents share buckets with (for
copies of one original, the original); links join into components. Where a bucket then still holds several, its members
are described by what they lack of the leader and what they add. A member outside the leader's component can link with
another only if they share some of these differences and hold few others before the rarest that they share, so the two
meet in a join on atoms of differences (see ``across``). So no bucket's pairs are all formed, and no pair that shares a
band and could join two components is lost. A pair of similarity 0.8 shares none of 40 bands of 5 with a probability of
1e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm._shared import over_arrow, stored, text_of
from lineweave.llm.graph import components

MANTISSA = 10
CACHE_WORDS = 500_000
#: Share of the pairs at the threshold that the bands may miss.
MISS = 1e-3
_U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def shingles(text: str, words: int, hashes: WordHashes) -> np.ndarray:
    r"""Sorted distinct 64-bit hashes of a text's shingles: A-Z lower-cased, words ``[^\x20\x09-\x0D]+``."""
    found = text.encode().translate(_LOWER).split()
    n = len(found)
    if not n:
        return np.empty(0, _U)
    w = np.fromiter(map(hashes.__getitem__, found), _U, n)
    size = min(n, words)
    h = np.full(n - size + 1, size, _U)
    for j in range(size):
        h = mixed(h + w[j : n - size + 1 + j])
    return np.unique(h)


class Sketcher:
    """Registers and band keys of shingle sets."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.m = bands, rows, bands * rows
        self.width = (1 << 64) // self.m + 1
        self.starts = np.arange(self.m, dtype=_U) * _U(self.width)
        rng = np.random.default_rng(20)
        self.probes = np.stack([rng.permutation(self.m) for _ in range(self.m)])
        self.salts = mixed(np.arange(1, bands + 1, dtype=_U))

    def registers(self, found: np.ndarray) -> np.ndarray:
        at = np.searchsorted(found, self.starts)
        ends = np.append(at[1:], len(found))
        filled = at < ends
        least = found[np.minimum(at, len(found) - 1)] - self.starts
        scaled = np.where(filled, least, 0) * _U(self.m - 1)  # back over 64 bits
        zeros = 63 - np.frexp(np.maximum(scaled, 1).astype(np.float64))[1] + 1
        zeros = np.clip(zeros, 0, 62).astype(_U)
        body = (scaled << (zeros + _U(1))) >> _U(64 - MANTISSA)
        value = ((zeros << _U(MANTISSA)) | body).astype(np.uint16)
        empty = np.flatnonzero(~filled)
        if len(empty):
            probes = self.probes[empty]
            value[empty] = value[probes[np.arange(len(empty)), filled[probes].argmax(axis=1)]]
        return value

    def keys(self, registers: np.ndarray) -> np.ndarray:
        parts = registers.reshape(len(registers), self.bands, self.rows).astype(_U)
        h = np.broadcast_to(self.salts, parts.shape[:2])
        for j in range(self.rows):
            h = mixed(h + parts[:, :, j])
        return h


def sketches(df: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n, d1, d2 (the set's digest), registers (binary), keys (of the bands; empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, hashes = Sketcher(bands, rows), WordHashes()
        for batch in batches:
            sizes, digests, registers = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, words, hashes)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                registers.append(sketcher.registers(found) if len(found) else None)
            full = np.array([r for r in registers if r is not None], np.uint16).reshape(-1, sketcher.m)
            keys = iter(sketcher.keys(full).view(np.int64)) if len(full) else iter(())
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                    pa.array([None if r is None else r.tobytes() for r in registers], pa.binary()),
                    pa.array([[] if r is None else next(keys) for r in registers], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "d1", "d2", "registers", "keys"],
            )

    return over_arrow(df, run, "doc_id long, n long, d1 long, d2 long, registers binary, keys array<long>")


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Jaccard estimate from equal registers, less the share that different minima agree by accident.

    Two minima of buckets with loads a and b fall on one register value with probability about
    0.68 * 2^-mantissa * a * b / (a + b)^2.
    """
    same = (x == y).mean(axis=1)
    accident = 0.68 * 2.0**-MANTISSA * n * k / (n + k) ** 2
    return (same - accident) / (1 - accident)


def likely(pairs: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose corrected estimate is at most 6 standard errors under the threshold, by the filled registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, k = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (4, 5))
            filled = x.shape[1] * (1 - np.exp(-np.minimum(n, k) / x.shape[1]))
            slack = 6 * np.sqrt(percent / 100 * (1 - percent / 100) / filled)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(estimate(x, y, n, k) >= percent / 100 - slack))

    side = lambda c: sketched.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    # sizes alone bound the similarity from above
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return over_arrow(both.select("a", "b", "na", "nb", "ra", "rb"), run, "a long, b long")


def side_by_side(pairs: DataFrame, df: DataFrame) -> DataFrame:
    """Pairs (a, b) with their texts (ta, tb); only texts of the pairs' ends are shuffled twice."""
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = stored(df.join(ends, "doc_id", "left_semi"), "texts")
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")


def two_sets(batch: pa.RecordBatch, words: int, hashes: WordHashes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    last: tuple[str | None, np.ndarray] = (None, np.empty(0, _U))
    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
        if x != last[0]:
            last = (x, shingles(x, words, hashes))
        yield last[1], shingles(y, words, hashes)


def confirmed(pairs: DataFrame, df: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union, on the full sets of the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keep = []
            for s, t in two_sets(batch, words, hashes):
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return over_arrow(side_by_side(pairs, df), run, "a long, b long")


def across(stars: DataFrame, df: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between members of different components that share a leader.

    ``stars``: leader, member, inside (the member's component), outside (it is not the leader's). A member is told by
    its differences from the leader, what it lacks and what it adds: as many of them lie in one of two members alone as
    shingles do. Sets of n1 and n2 link just if at most h = (n1 + n2) (100 - p) / (100 + p) shingles lie in one alone, so

        2 |e1 - e2| <= |e1| - |e2| + h,  2 |e2 - e1| <= |e2| - |e1| + h

    for their differences e1 and e2. They share one, if either is outside: with none in common, the one that is
    not linked with the leader would be farther still from the other. Differences that the same members of a star hold
    count as one atom with their number as its weight; those that a member holds alone are only counted. In one order of
    a star's atoms, rarest first, all that a member holds before the first atom that two share lies in it alone. So
    members meet on atoms before which each has no more weight than these bounds allow, which leaves few pairs to be
    counted out. No pair that links is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for s, t in two_sets(batch, words, hashes):
                more, less = np.setdiff1d(t, s, assume_unique=True), np.setdiff1d(s, t, assume_unique=True)
                rows.append((len(s), len(less), len(more), np.concatenate([more, less]).view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds))], names=["a", "b", "l", "d", "m", "e"])

    pairs = stars.select(F.col("leader").alias("a"), F.col("member").alias("b"))
    told = over_arrow(side_by_side(pairs, df), run, "a long, b long, l long, d long, m long, e array<long>")
    told = stored(told.join(stars.select(F.col("leader").alias("a"), F.col("member").alias("b"), "inside", "outside"), ["a", "b"]), "differences")
    p = percent
    each = told.select("a", "b", F.explode("e").alias("at"))
    # hashes over members tell sets of them apart; stored, so that the join with it may split differences that many hold
    held = stored(each.groupBy("a", "at").agg(F.count(F.lit(1)).alias("holders"), F.bit_xor(F.xxhash64("b")).alias("who")).where("holders > 1").withColumn("atom", F.xxhash64("who", "holders")).select("a", "at", "holders", "atom"), "held")
    atoms = each.join(held, ["a", "at"]).groupBy("a", "b", "holders", "atom").agg(F.count(F.lit(1)).alias("weight"))
    member = Window.partitionBy("a", "b")
    before = F.sum("weight").over(member.orderBy("holders", "atom")) - F.col("weight")
    atoms = atoms.select("a", "b", "atom", before.alias("before"), F.sum("weight").over(member).alias("shared"))
    n = F.col("l") - F.col("d") + F.col("m")
    about = told.select("a", "b", "inside", "outside", "d", "m", n.alias("n"), F.floor(n * (100 - p) / p).alias("most"))
    skip = F.col("d") + F.col("m") - F.col("shared") + F.col("before")
    placed = stored(atoms.join(about, ["a", "b"]).withColumn("skip", skip).where("skip <= most").drop("before", "shared"), "atoms")
    side = lambda c: [F.col(i).alias(f"{c}_{i}") for i in ("a", "atom", "b", "inside", "outside", "d", "m", "n", "skip")]
    x, y = placed.where("2 * skip <= most").select(*side("x")), placed.select(*side("y"))
    apart = (F.col("x_inside") != F.col("y_inside")) & (F.col("x_outside") | F.col("y_outside"))
    far = F.floor((F.col("x_n") + F.col("y_n")) * (100 - p) / (100 + p))
    longer = F.col("y_d") + F.col("y_m") - F.col("x_d") - F.col("x_m")
    first = (longer > 0) | ((longer == 0) & (F.col("x_b") < F.col("y_b")))
    near = (F.abs(F.col("x_d") - F.col("y_d")) + F.abs(F.col("x_m") - F.col("y_m")) <= far) & (2 * F.col("x_skip") <= far - longer) & (2 * F.col("y_skip") <= far + longer)
    met = x.join(y, (F.col("x_a") == F.col("y_a")) & (F.col("x_atom") == F.col("y_atom")) & apart & first & near).select(F.col("x_a").alias("a"), "x_b", "y_b").distinct()
    full = lambda c: told.select("a", F.col("b").alias(f"{c}_b"), F.col("l").alias(f"{c}_l"), F.col("d").alias(f"{c}_d"), F.col("m").alias(f"{c}_m"), F.col("e").alias(f"{c}_e"))
    both = met.join(full("x"), ["a", "x_b"]).join(full("y"), ["a", "y_b"])
    s = F.size(F.array_intersect("x_e", "y_e"))
    linked = 100 * (F.col("x_l") - F.col("x_d") - F.col("y_d") + s) >= p * (F.col("x_l") + F.col("x_m") + F.col("y_m") - s)
    return both.where(linked).select(F.least("x_b", "y_b").alias("a"), F.greatest("x_b", "y_b").alias("b")).distinct()


def near_duplicates(df: DataFrame, *, words: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Returns ``doc_id``, ``n_shingles``, ``component_id`` (least id reachable, itself included) and ``kept`` (the row
    holds that id). Ids are longs.

    Null and empty texts have an empty set and link with nothing. Texts with fewer than ``words`` words are one
    shingle. Rows without an id take no part in links: component null, not kept. Rows that share an id count as one
    document. Repeated rows repeat in the result. Other columns are not read. Thresholds of whose pairs ``bands`` of ``rows``
    would miss more than ``MISS`` are refused.
    """
    if (missed := (1 - (percent / 100) ** rows) ** bands) > MISS:
        raise ValueError(f"{bands} bands of {rows} rows miss {missed:.2g} of the pairs at {percent} percent: take more bands or fewer rows")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    sketched = stored(sketches(docs, words, bands, rows), "sketches")
    members = sketched.select("doc_id", "n", "d1", "d2")
    # stored, so that joins with it may split the keys of large groups of copies
    classes = stored(members.where("doc_id is not null and n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    firsts = stored(sketched.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "d1", "d2"], "left_semi").select("doc_id", "n", "registers", "keys"), "firsts")

    banded = firsts.select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key", "size")
    buckets = stored(banded.join(shared, "key"), "buckets")
    # texts of all that share a bucket, shuffled once; by a merge join at every size
    members_of = buckets.select(F.col("rep").alias("doc_id")).distinct()
    pool = stored(docs.join(members_of.hint("merge"), "doc_id", "left_semi"), "pool")
    central = buckets.groupBy("rep").agg(F.sum("size").alias("weight"))
    weighed = buckets.select("key", "rep").join(central, "rep")
    leaders = stored(weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"))).alias("top")).select("key", (-F.col("top.rep")).alias("leader")), "leaders")

    def ordered(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    tried = stored(buckets.join(leaders, "key").where("rep <> leader").select(*ordered("rep", "leader")).distinct(), "tried")
    links = stored(confirmed(stored(likely(tried, firsts, percent), "likely"), pool, words, percent), "links")
    labels = components(links)

    def labelled(x: DataFrame, c: str) -> DataFrame:
        return x.join(labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")), c, "left").withColumn(f"{c}_in", F.coalesce(f"{c}_in", c))

    at = labelled(buckets.select("key", "rep"), "rep")
    split = at.groupBy("key").agg(F.min("rep_in").alias("lo"), F.max("rep_in").alias("hi")).where("lo < hi").select("key")
    open_ = at.join(split, "key").join(labelled(leaders, "leader"), "key").where("rep <> leader")
    stars = open_.select("leader", F.col("rep").alias("member"), F.col("rep_in").alias("inside"), (F.col("rep_in") != F.col("leader_in")).alias("outside")).distinct()
    # a star of one member has nobody else to link with
    busy = stars.groupBy("leader").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("leader")
    more = stored(across(stored(stars.join(busy, "leader"), "stars"), pool, words, percent), "links")
    if not more.isEmpty():
        labels = components(links.union(more))

    copies = classes.join(labels, classes.rep == labels.node, "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = members.join(copies, ["d1", "d2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
