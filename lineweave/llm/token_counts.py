"""Counts of greedy longest-match word pieces, from an automaton that never builds the pieces.

The trie holds the vocabulary's first pieces below one root and its continuation pieces below another. Each node has a
failure link: the node reached after popping the longest pieces that cover its string, and the number of pieces popped.
A word is read once from left to right; where the trie has no branch, links are followed and their counts added. That
is linear in the word, as each link consumes characters that were read before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm._shared import PerWorker, over_arrow, text_of

MAX_PIECES = 2_000_000
CACHE_WORDS = 500_000


class PieceCounter(dict):
    """Maps a word to its number of pieces, or to -1 if pieces cannot cover it.

    ``first``: pieces that may begin a word. ``rest``: pieces that may continue one. Both are sequences of symbols
    (strings or bytes).
    """

    def __init__(self, first: Iterable, rest: Iterable):
        super().__init__()
        first, rest = list(first), list(rest)
        if len(first) + len(rest) > MAX_PIECES:
            raise ValueError(f"more than {MAX_PIECES} pieces")
        self.next: list[dict] = [{}, {}]  # node 0: start of a word; node 1: after a piece
        self.ends: list[bool] = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for symbol in piece:
                    into = self.next[node]
                    if symbol not in into:
                        into[symbol] = len(self.next)
                        self.next.append({})
                        self.ends.append(False)
                    node = into[symbol]
                if node != root:
                    self.ends[node] = True
        self.fail: list[int] = [-1] * len(self.next)
        self.pops: list[int] = [0] * len(self.next)
        level = [0, 1]
        while level:
            deeper = []
            for node in level:
                for symbol, child in self.next[node].items():
                    deeper.append(child)
                    if self.ends[child]:
                        self.fail[child], self.pops[child] = 1, 1
                        continue
                    at, popped = self.fail[node], self.pops[node]
                    while at >= 0 and symbol not in self.next[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.pops[child] = self.next[at][symbol], popped
            level = deeper

    def count(self, word) -> int:
        node, total = 0, 0
        nexts, fails, pops = self.next, self.fail, self.pops
        for symbol in word:
            while (to := nexts[node].get(symbol)) is None:
                total += pops[node]
                node = fails[node]
                if node < 0:
                    return -1
            node = to
        while node != 1:
            if node <= 0:
                return -1 if word else 0
            total += pops[node]
            node = fails[node]
        return total

    def __missing__(self, word) -> int:
        n = self.count(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 256:
            self[word] = n
        return n


def _build(pieces: tuple[list, list]) -> PieceCounter:
    return PieceCounter(*pieces)


def split_byte_vocabulary(ranks: str) -> tuple[list[bytes], list[bytes]]:
    """First and continuation pieces of a byte-level rank file: pieces that begin with a space begin a word."""
    import base64

    with open(ranks, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


def token_counts(df: DataFrame, first: list[bytes], rest: list[bytes], *, id_col: str = "doc_id", text_col: str = "text", mark: bytes = b" ") -> DataFrame:
    r"""Number of greedy longest-match pieces of every whole text.

    Words are the runs of ``[^\x20\x09-\x0D]``, taken as UTF-8 after ``mark``, so that first pieces are those that
    begin with it. Returns ``id_col``, ``n_words``, ``n_tokens`` and ``n_unknown`` (longs): a word that pieces cannot
    cover is one token and counts as unknown. One narrow pass; the pieces (``MAX_PIECES`` at most) are broadcast.

    Null and empty texts give zeros; null ids stay null; repeated rows give one result each; an empty table gives
    none; other columns are not read.
    """
    shared = PerWorker(df.sparkSession, (first, rest), _build)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.get()
        get = counter.__getitem__
        for batch in batches:
            rows: tuple[list[int], list[int], list[int]] = ([], [], [])
            for text in batch.column(1).to_pylist():
                counts = [get(mark + w) for w in text.encode().split()]
                unknown = counts.count(-1)
                for out, n in zip(rows, (len(counts), sum(counts) + 2 * unknown, unknown)):
                    out.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in rows)], names=[id_col, "n_words", "n_tokens", "n_unknown"])

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long"
    return over_arrow(df.select(F.col(id_col), text_of(text_col).alias("text")), run, schema)
