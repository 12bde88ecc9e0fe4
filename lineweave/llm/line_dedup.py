"""Line dedup by pairwise alignment: later documents lose the blocks of lines that an earlier one has in the same order.

Documents overlap if they share the hash of a line of ``min_words`` words or more, which does not recur by chance. Each
line links a document only with the first document that holds it, so pairs stay linear in the lines even where a third of
all rows share one. ``every_block`` links also by runs of shorter lines, the fewest up to or from a line that reach
``min_words``, and links those that alignment leaves with their later holders too, one for each text, in rounds of growing
size until none is left to try. Each line of a block that may leave lies in a run within that block: the last run from a
line that fits in it, or the run up to the line, which begins where that one does. Scripts without spaces count two
characters as a word. A pair is aligned by patience diff: lines unique on both sides and in
increasing order are anchors, equal neighbours extend them, and the stretches between are aligned the same way.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm._shared import over_arrow, stored, text_of

LINES = "doc_id long, key long, hashes array<long>, words array<int>, runs array<long>, starts array<int>, ends array<int>"
#: Characters of scripts that are written without spaces: Thai, Lao, Burmese, Khmer, kana, Chinese.
SPACELESS = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def measured(line: str) -> int:
    """Words of a line; two characters of a script without spaces are one."""
    words = len(line.split())
    return words if line.isascii() else max(words, len(SPACELESS.findall(line)) // 2)


def runs_of(hashes: list[int], words: list[int], min_words: int) -> tuple[list[int], list[int], list[int]]:
    """Hash, first line and end of each run: the fewest lines from a line on, or up to it, that reach ``min_words``.

    Lines without words do not enter the hash.
    """
    full = [i for i, n in enumerate(words) if n]
    spans = set()
    last, total = 0, 0
    for at, i in enumerate(full):
        while last < len(full) and total < min_words:
            total += words[full[last]]
            last += 1
        if total < min_words:
            break
        spans.add((at, last))
        total -= words[i]
    first, total = 0, 0
    for at, i in enumerate(full):
        total += words[i]
        while total - words[full[first]] >= min_words:
            total -= words[full[first]]
            first += 1
        if total >= min_words:
            spans.add((first, at + 1))
    runs = [hashes[full[x]] if y == x + 1 else xxhash.xxh3_64_intdigest(b"".join(hashes[full[z]].to_bytes(8, "little", signed=True) for z in range(x, y))) - (1 << 63) for x, y in spans]
    return runs, [full[x] for x, _ in spans], [full[y - 1] + 1 for _, y in spans]


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions (i, j) with a[i] = b[j] that patience diff aligns, both increasing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        once_a, once_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        at_b = {x: y for y, x in enumerate(b[j:j_end], j) if once_b[x] == 1}
        found = [(x, at_b[h]) for x, h in enumerate(a[i:i_end], i) if once_a[h] == 1 and h in at_b]
        # longest run of anchors in increasing order, by patience sorting
        tops: list[int] = []
        piles: list[int] = []
        before = [-1] * len(found)
        for at, (_, y) in enumerate(found):
            pile = bisect_left(tops, y)
            before[at] = piles[pile - 1] if pile else -1
            tops[pile : pile + 1], piles[pile : pile + 1] = [y], [at]
        chain, at = [], piles[-1] if piles else -1
        while at >= 0:
            chain.append(found[at])
            at = before[at]
        if chain:
            out += chain
            corners = [(i - 1, j - 1), *reversed(chain), (i_end, j_end)]
            todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(corners, corners[1:])]
    return sorted(out)


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Lines of ``b`` in aligned blocks of at least ``min_words`` words."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*aligned(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[x] for x in block) >= min_words:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def line_hashes(docs: DataFrame, min_words: int) -> DataFrame:
    """Each document's lines as hashes (of the line without white space at its ends) and word counts, and its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            lines = [[x.strip() for x in t.split("\n")] for t in batch.column(2).to_pylist()]
            hashes = [[h - (1 << 64) if (h := digest(x.encode())) >> 63 else h for x in own] for own in lines]
            words = [[measured(x) for x in own] for own in lines]
            runs, starts, ends = zip(*(runs_of(h, w, min_words) for h, w in zip(hashes, words))) if lines else ((), (), ())
            long, short = pa.list_(pa.int64()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, long), pa.array(words, short), pa.array(runs, long), pa.array(starts, short), pa.array(ends, short)], names=["doc_id", "key", "hashes", "words", "runs", "starts", "ends"])

    return over_arrow(docs, run, LINES)


def unsettled(lines: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc, h): runs of ``lines`` that keep a line that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for words, runs, starts, ends, lost in zip(*(batch.column(i).to_pylist() for i in range(2, 7))):
                out = set(lost or ())
                found.append(list({h for h, i, end in zip(runs, starts, ends) if any(words[x] and x not in out for x in range(i, end))}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "key", "runs"])

    one = lines.dropDuplicates(["doc_id", "key"])
    left = one.join(gone, (one.key == gone.b_key) & one.doc_id.eqNullSafe(gone.b), "left").select("doc_id", "key", "words", "runs", "starts", "ends", "gone")
    return over_arrow(left, run, "doc_id long, key long, runs array<long>").select(F.struct("doc_id", "key").alias("doc"), F.explode("runs").alias("h"))


def common_lines(df: DataFrame, min_words: int, id_col: str, text_col: str, every_block: bool) -> DataFrame:
    """(b, b_key, gone): positions of the lines that each later document loses; documents that lose none are absent."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("key"), text_of(text_col).alias("text"))
    lines = stored(line_hashes(docs, min_words), "lines")
    rare = lines.select("doc_id", "key", F.explode(F.arrays_zip("runs", "starts", "ends")).alias("line")).where(F.lit(every_block) | F.expr("line.ends = line.starts + 1"))
    rare = rare.select(F.struct("doc_id", "key").alias("doc"), F.col("line.runs").alias("h"))
    # stored, so that the join with it may split the keys of very common lines
    firsts = stored(rare.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("h", "first"), "firsts")
    pairs = rare.join(firsts, "h").where("doc > first").select(F.col("first.doc_id").alias("a"), F.col("first.key").alias("a_key"), F.col("doc.doc_id").alias("b"), F.col("doc.key").alias("b_key")).distinct()
    one = lines.dropDuplicates(["doc_id", "key"])

    def beside(x: DataFrame, c: str) -> DataFrame:
        own = one.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("hashes").alias(f"{c}_h"), F.col("words").alias(f"{c}_w"))
        return x.join(own, (F.col(f"{c}_key") == F.col("__key")) & F.col(c).eqNullSafe(F.col("__id"))).drop("__id", "__key")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [common_blocks(*x, min_words) for x in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["b", "b_key", "gone"])

    def losses(pairs: DataFrame) -> DataFrame:
        both = beside(beside(pairs, "a"), "b").select("b", "b_key", "a_h", "b_h", "b_w")
        return over_arrow(both, align, "b long, b_key long, gone array<int>").groupBy("b", "b_key").agg(F.flatten(F.collect_list("gone")).alias("gone"))

    gone = losses(pairs)
    if not every_block:
        return gone
    gone = stored(gone, "gone")
    left = stored(unsettled(lines, gone).join(firsts, "h").where("doc > first").select("doc", "h"), "left")
    # holders of what is left, one for each text, in order
    held = rare.join(left.select("h").distinct(), "h", "left_semi").groupBy("h", F.col("doc.key").alias("key")).agg(F.min("doc").alias("holder"))
    held = stored(held.select("h", "holder", F.row_number().over(Window.partitionBy("h").orderBy("holder")).alias("rank")), "holders")
    low, high = 1, 2
    while True:
        pairs = left.join(held.where((F.col("rank") > low) & (F.col("rank") <= high)), "h").where("holder < doc")
        pairs = stored(pairs.select(F.col("holder.doc_id").alias("a"), F.col("holder.key").alias("a_key"), F.col("doc.doc_id").alias("b"), F.col("doc.key").alias("b_key")).distinct(), "pairs")
        if pairs.isEmpty():
            return gone
        gone = stored(gone.unionByName(losses(pairs)).groupBy("b", "b_key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")), "gone")
        ids = left.select(F.col("doc.doc_id").alias("__id"), F.col("doc.key").alias("__key")).distinct()
        own = lines.join(ids, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
        still = unsettled(own, gone).select(F.col("doc").alias("__doc"), F.col("h").alias("__h"))
        left = stored(left.join(still, (F.col("h") == F.col("__h")) & F.col("doc").eqNullSafe(F.col("__doc")), "left_semi"), "left")
        low, high = high, 4 * high


def dedup_lines(df: DataFrame, *, min_words: int = 5, every_block: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Delete from each document the blocks of lines that it shares with an earlier one.

    Returns ``doc_id``, ``key`` (hash of the input text), ``n_lines``, ``n_removed``, ``kept`` (the text left) and
    ``kept_sha256``. Earlier means of smaller id. What is common is judged on the input, so the order of work does not
    matter. Blocks of fewer than ``min_words`` words stay. ``every_block`` finds all blocks in all earlier documents; without it,
    lines of ``min_words`` words link a document with their first holder alone.

    Null texts count as empty, with one empty line, and stay empty. Null ids come before all others. Rows with equal id
    and text are one document and have one result each; rows with equal id and different texts are ordered by ``key``.
    An empty table gives none. Other columns are not read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("key"), text_of(text_col).alias("text"))
    gone = common_lines(df, min_words, id_col, text_col, every_block)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, positions in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                own, out = text.split("\n"), set(positions or ())
                counts.append(len(own))
                removed.append(len(out))
                kept.append("\n".join(x for i, x in enumerate(own) if i not in out) if out else text)
            cols = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n_lines", "n_removed", "kept", "kept_sha256"])

    left = docs.join(gone, (docs.key == gone.b_key) & docs.doc_id.eqNullSafe(gone.b), "left").select("doc_id", "key", "text", "gone")
    return over_arrow(left, cut, "doc_id long, key long, n_lines long, n_removed long, kept string, kept_sha256 string")


def without_common_lines(df: DataFrame, *, min_words: int = 5, every_block: bool = False, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """``df`` with its columns, texts cut as by ``dedup_lines`` and their lengths renewed; documents that lose all their words go.

    Documents that lose nothing stay as they are, null texts included. Texts are shuffled once.
    """
    gone = common_lines(df, min_words, id_col, text_col, every_block).toDF("__id", "__key", "__gone")
    joined = df.join(gone, (F.xxhash64(text_of(text_col)) == F.col("__key")) & F.col(id_col).cast("long").eqNullSafe(F.col("__id")), "left").select(*df.columns, "__gone")
    at = df.columns.index(text_col)
    size_at = df.columns.index(n_chars_col) if n_chars_col in df.columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            gone = columns.pop().to_pylist()
            texts = [t if not g else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in s) for t, g in zip(columns[at].to_pylist(), gone) for s in (set(g or ()),)]
            columns[at] = pa.array(texts, columns[at].type)
            if size_at is not None:
                sizes = [len(t) if g else n for t, g, n in zip(texts, gone, columns[size_at].to_pylist())]
                columns[size_at] = pa.array(sizes, columns[size_at].type)
            keep = [not g or bool(t.strip()) for t, g in zip(texts, gone)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return over_arrow(joined, cut, df.schema)
