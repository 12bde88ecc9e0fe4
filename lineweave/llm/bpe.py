"""Byte-pair encoding and decoding with a public byte-level vocabulary.

Short words are merged on contiguous arrays: the parts' ids and the ranks of adjacent pairs. The smallest rank is
searched by scanning, its boundary is deleted and the ranks on both sides are refreshed. Words beyond ``SCAN_LIMIT``
bytes take the same merges from a heap over linked parts, as repeated scans are quadratic in a word's length.

Spark partitions the texts; the vocabulary (a file of fixed size, checked against ``MAX_VOCABULARY_BYTES``) is broadcast
and each Python worker keeps the ids of words that it has seen.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm._shared import PerWorker, over_arrow, text_of

MAX_VOCABULARY_BYTES = 64 << 20
SCAN_LIMIT = 256
#: Words whose ids a worker keeps; then it starts afresh, so that memory is bounded.
CACHE_WORDS = 400_000
#: Fixed value: the split of the byte-level pre-tokenizer, written with the property that \s stands for there.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_NONE = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class BytePairCodec(dict):
    """Maps a word to its ids (little-endian unsigned 32-bit); missing words are merged and kept."""

    def __init__(self, spec: str):
        super().__init__()
        model = (whole := json.loads(spec))["model"]
        letters = byte_letters()
        vocab = model["vocab"]
        back = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [vocab[c] for c in letters]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.added = {t["content"]: t["id"] for t in whole.get("added_tokens", ())}
        top = max([*vocab.values(), *self.added.values()]) + 1
        self.tokens = [b""] * top
        for piece, i in vocab.items():
            self.tokens[i] = bytes(back[c] for c in piece)
        for piece, i in self.added.items():
            self.tokens[i] = piece.encode()
        self.words = regex.compile(WORDS).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        ids = (self.scan if len(raw) <= SCAN_LIMIT else self.heap)([self.byte_ids[b] for b in raw])
        out = np.array(ids, "<u4").tobytes()
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(raw) <= SCAN_LIMIT:
            self[word] = out
        return out

    def rank(self, a: int, b: int) -> int:
        return self.pairs.get(a << 32 | b, (_NONE,))[0]

    def scan(self, parts: list[int]) -> list[int]:
        ranks = [self.rank(a, b) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = self.pairs[parts[i] << 32 | parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = self.rank(parts[i - 1], parts[i])
            if i < len(ranks):
                ranks[i] = self.rank(parts[i], parts[i + 1])
        return parts

    def heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank(parts[i], parts[i + 1])) != _NONE]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i] if live[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], live[j] = self.pairs[a << 32 | b][1], False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if 0 <= x and y < n and (r := self.rank(parts[x], parts[y])) != _NONE:
                    heapq.heappush(queue, (r, x, parts[x], parts[y]))
        return [p for p, ok in zip(parts, live) if ok]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text; strings of added tokens in it become those tokens."""
        get = self.__getitem__
        if self.split is None or not any(t in text for t in self.added):
            return b"".join(map(get, self.words(text)))
        return b"".join(
            np.array([self.added[x]], "<u4").tobytes() if x in self.added else b"".join(map(get, self.words(x)))
            for x in self.split(text)
            if x
        )

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that the ids stand for."""
        raw = b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()
        return raw


def read_vocabulary(path: str) -> str:
    """The tokenizer file's content; refuses files over ``MAX_VOCABULARY_BYTES``, as it is broadcast."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} exceeds {MAX_VOCABULARY_BYTES} bytes")
    return raw.decode()


def bpe_encode(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns ``id_col``, ``n_tokens`` long, ``ids_sha256`` and ``decoded_sha256`` (lowercase hex), and with ``with_ids``
    also ``ids`` (array<int>) and ``decoded``. One narrow pass without a shuffle.

    Null and empty texts: no tokens, hashes of nothing. Null ids stay null. Repeated rows: one result each. An empty
    table gives none. Other columns of ``df`` are not read, whatever their names.
    """
    shared = PerWorker(df.sparkSession, read_vocabulary(vocabulary), BytePairCodec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.get()
        sha = hashlib.sha256
        for batch in batches:
            encoded = [codec.encode(t) for t in batch.column(1).to_pylist()]
            decoded = [codec.decode(x) for x in encoded]
            cols = [
                batch.column(0),
                pa.array([len(x) // 4 for x in encoded], pa.int64()),
                pa.array([sha(x).hexdigest() for x in encoded], pa.string()),
                pa.array([sha(x).hexdigest() for x in decoded], pa.string()),
            ]
            if with_ids:
                cols += [pa.array([np.frombuffer(x, "<i4") for x in encoded], pa.list_(pa.int32())), pa.array([x.decode() for x in decoded], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if with_ids else ())]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return over_arrow(df.select(F.col(id_col), text_of(text_col).alias("text")), run, schema)


def bpe_decode(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts from arrays of token ids: ``id_col``, ``decoded``. Null arrays count as empty; ids outside the vocabulary fail."""
    shared = PerWorker(df.sparkSession, read_vocabulary(vocabulary), BytePairCodec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.get()
        for batch in batches:
            texts = [codec.decode(np.array(x or [], "<u4").tobytes()).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    return over_arrow(df.select(id_col, F.col(ids_col).cast("array<long>").alias("ids")), run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, decoded string")
