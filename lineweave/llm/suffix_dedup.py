"""Exact removal of bytes that a repeated string of ``length`` bytes covers.

Each start of a string of ``length`` bytes is named by the least hash among the grams in it (a sample of suffixes that
depends on content alone, about one in 77 bytes), so equal strings have equal names at equal offsets. Runs of starts
with one sampled suffix are compared before single starts are, and equality is induced from the coarser level to the
finer: names that occur once settle their starts; runs with equal contexts (all bytes of all their strings) settle
theirs as repeated; only where a name has different contexts, at the edges of repeated passages, are strings
themselves compared, one context for each class. Spark's external sorts and shuffles, which spill to disk, hold what is
compared. README.md says why this is not a byte-wise external induced sort.

Names have 64 bits and strings are told apart by name and a second hash of 64 bits, within a name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm._shared import over_arrow, stored, text_of
from lineweave.llm.minhash import mixed

GRAM = 48
#: Starts of a text that are hashed at a time.
CHUNK = 1 << 20
#: Contexts of one name that a task compares; names with more are compared string by string in a shuffle.
NAME_ROWS = 20_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


class Roller:
    """Hashes of all substrings of a byte string, from running sums modulo 2^64."""

    def __init__(self):
        self.letters = np.random.default_rng(48).integers(1 << 63, size=256, dtype=np.uint64) * _U(2) + _U(1)
        self.up = self.down = np.ones(1, _U)

    def load(self, data: np.ndarray) -> None:
        n = len(data)
        if len(self.up) <= n:
            size = max(2 * len(self.up), n + 1)
            self.up = np.full(size, _BASE, _U)
            self.down = np.full(size, pow(_BASE, -1, 1 << 64), _U)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)
        self.sums = np.empty(n + 1, _U)
        self.sums[0] = 0
        np.cumsum(self.letters[data] * self.up[:n], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` values, from minima towards both ends of blocks."""
    n = len(v) - w + 1
    blocks = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, _U)
    blocks[: len(v)] = v
    blocks = blocks.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def sampled_runs(data: np.ndarray, length: int, roller: Roller) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, name, context) of each run of starts with one sampled suffix; run = first start * 256 + number of starts."""
    parts: list[tuple] = []
    gram = min(GRAM, length)
    width = length - gram + 1
    for at in range(0, len(data) - length + 1, CHUNK):
        part = data[at : at + CHUNK + length - 1]
        roller.load(part)
        grams = roller.all(gram)
        tagged = (grams & _U(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=_U)
        sample = sliding_least(tagged, width) & _U(0xFFFFFF)
        first = np.concatenate([[0], np.flatnonzero(sample[1:] != sample[:-1]) + 1])
        count = np.diff(np.append(first, len(sample)))
        chosen = sample[first].astype(np.int64)
        context = roller.hashes(first, first + count + length - 1) + (((chosen - first) << 8) + count).astype(_U) * _U(_BASE)
        parts.append((((first + at) << 8) + count, grams[chosen].view(np.int64), mixed(context).view(np.int64)))
    if not parts:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*parts))


def runs(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in batches:
            found = [sampled_runs(np.frombuffer(t.encode(), np.uint8), length, roller) for t in batch.column(2).to_pylist()]
            sizes = [len(f[0]) for f in found]
            ids = np.repeat(np.arange(len(found)), sizes)
            cols = [batch.column(0).take(pa.array(ids)), batch.column(1).take(pa.array(ids)), *(pa.array(np.concatenate(x)) for x in zip(*found))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "run", "name", "context"])

    return over_arrow(docs, run, "doc_id long, key long, run long, name long, context long")


def string_keys(data: list[bytes], length: int, roller: Roller) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each string of ``length`` bytes in each of ``data``, and how many strings each has."""
    sizes = np.array([len(d) for d in data])
    roller.load(np.frombuffer(b"".join(data), np.uint8))
    counts = sizes - length + 1
    starts = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return roller.hashes(starts, starts + length), counts


def repeated_pieces(hit: np.ndarray, first: int) -> list[int]:
    """Runs (start * 256 + number) of the True positions of ``hit``, whose position 0 is the start ``first``."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [(first + a << 8) + b - a for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


SPANS = "doc_id long, key long, run long"


def compare_small(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated starts of the contexts with n = 1; all contexts of a name are in one partition, next to one another."""

    def settle(rows: list[tuple], roller: Roller) -> Iterator[tuple[int, int, int]]:
        keys, counts = string_keys([r[5] for r in rows], length, roller)
        names = np.repeat(np.array([r[0] for r in rows], np.int64), counts)
        _, which, times = np.unique(mixed(keys + mixed(names.view(_U))), return_inverse=True, return_counts=True)
        hit = times[which] > 1
        ends = np.cumsum(counts)
        for r, end, n in zip(rows, ends.tolist(), counts.tolist()):
            if r[1] == 1 and hit[end - n : end].any():
                for piece in repeated_pieces(hit[end - n : end], r[4] >> 8):
                    yield r[2], r[3], piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        rows: list[tuple] = []

        def out(part: list[tuple]) -> pa.RecordBatch:
            found = list(zip(*settle(part, roller))) if part else []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found or ([], [], [])], names=["doc_id", "key", "run"])

        for batch in batches:
            rows += zip(*(batch.column(i).to_pylist() for i in range(6)))
            if len(rows) >= 4096:
                cut = len(rows) - 1
                while cut and rows[cut - 1][0] == rows[-1][0]:
                    cut -= 1
                if cut:
                    yield out(rows[:cut])
                    rows = rows[cut:]
        yield out(rows)

    return over_arrow(contexts, run, SPANS)


def compare_large(contexts: DataFrame, length: int) -> DataFrame:
    """The same for names with many contexts: strings are counted by a shuffle that combines equal ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, counts = string_keys(batch.column(5).to_pylist(), length, roller)
            ids = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            starts = (np.repeat(batch.column(4).to_numpy() >> 8, counts) + within << 8) + 1
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(ids) for i in range(4)), pa.array(starts), pa.array(keys.view(np.int64))], names=["name", "n", "doc_id", "key", "run", "string"])

    strings = over_arrow(contexts, run, "name long, n long, doc_id long, key long, run long, string long")
    again = strings.groupBy("name", "string").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("name", "string")
    return strings.where("n = 1").join(again, ["name", "string"], "left_semi").select("doc_id", "key", "run")


def remove_repeats(df: DataFrame, *, length: int = 200, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """Remove each byte covered by a string of ``length`` UTF-8 bytes that also starts anywhere else.

    Overlaps count, the same document included; strings never cross documents and are judged on the input. Returns
    ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` and with ``with_kept``
    the remaining bytes, ``kept``.

    Null texts count as empty; texts shorter than ``length`` stay whole. Ids are longs and may be null. Repeated rows
    repeat each other and lose all strings; rows that share an id and differ in text are documents of their own. An
    empty table gives none. Other columns are not read. ``length`` is at least 2 and at most GRAM + 254.
    """
    if not 2 <= length <= GRAM + 254:
        raise ValueError("length is out of range")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("key"), text_of(text_col).alias("text"))
    found = runs(docs, length)
    # stored, so that the join with it may split the keys of very common passages
    names = stored(found.groupBy("name").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("name"), "names")
    shared = stored(found.join(names, "name", "left_semi"), "shared")
    classes = stored(shared.groupBy("name", "context").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("doc_id", "key", "run"))), "contexts")
    whole = shared.join(classes.where("n > 1").select("name", "context"), ["name", "context"], "left_semi").select("doc_id", "key", "run")

    several = stored(classes.groupBy("name").agg(F.count(F.lit(1)).alias("width")).where("width > 1"), "several")
    edges = classes.join(several, "name").groupBy("doc_id", "key").agg(F.collect_list(F.struct("name", "n", "run", "width")).alias("edges"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, key, text, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = text.encode()
                for e in own:
                    at = e["run"] >> 8
                    out.append((e["name"], e["n"], doc, key, e["run"], data[at : at + (e["run"] & 255) + length - 1], e["width"]))
            kinds = (pa.int64(),) * 5 + (pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names=["name", "n", "doc_id", "key", "run", "bytes", "width"])

    def beside(x: DataFrame, how: str, column: str) -> DataFrame:
        own = x.withColumnRenamed("doc_id", "__id").withColumnRenamed("key", "__key")
        return docs.join(own, (docs.key == own["__key"]) & docs.doc_id.eqNullSafe(own["__id"]), how).select("doc_id", "key", "text", column)

    contexts = stored(over_arrow(beside(edges, "inner", "edges"), slices, "name long, n long, doc_id long, key long, run long, bytes binary, width long"), "slices")
    six = ["name", "n", "doc_id", "key", "run", "bytes"]
    small = contexts.where(F.col("width") <= NAME_ROWS).select(six).repartition("name").sortWithinPartitions("name")
    spans = whole.union(compare_small(small, length)).union(compare_large(contexts.where(F.col("width") > NAME_ROWS).select(six), length))
    spans = spans.groupBy("doc_id", "key").agg(F.collect_list("run").alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode()
                pieces, end, spans = [], 0, 0
                first = True
                for x in sorted(own or ()):
                    at, stop = x >> 8, (x >> 8) + (x & 255) + length - 1
                    if first or at > end:
                        pieces.append(data[end:at])
                        spans += 1
                        end, first = stop, False
                    end = max(end, stop)
                pieces.append(data[end:])
                kept = b"".join(pieces)
                rows.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols[: 4 + with_kept]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_kept])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return over_arrow(beside(spans, "left", "spans").select("doc_id", "text", "spans"), cut, schema)
