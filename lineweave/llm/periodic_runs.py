"""Periodic runs of words: stretches that repeat with a period several times, and texts with the repeats taken out.

Squares are caught by dyadic blocks. Each completed block of 2^k words gets a catcher, which compares itself with the last
2^k words each time a word is appended, as long as the distance is 2^(k+1) - 1 to 2^(k+2) - 2; every square of such a
half-length has a whole block in its first half, so one level covers each distance. The words of a text are all at
hand, so the comparisons of all catchers of a level are one array operation: a row for each block, a column for each
appended word. Blocks are compared by hashes of doubling length; consecutive blocks caught at one distance merge into a
run, whose ends and words are then compared exactly.

Texts lie behind one another in groups, with separators that equal nothing.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm._shared import over_arrow, text_of

#: Comparisons made at a time.
CELLS = 1 << 22
#: Bytes of texts that lie behind one another; one text more at most.
GROUP_BYTES = 4 << 20
#: Fixed value: what stands between words.
_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over all 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _same_ahead(ids: np.ndarray, i: int, j: int) -> int:
    """How many words from ``i`` on equal those from ``j`` on (i < j)."""
    n, step = 0, 32
    while j + n < len(ids):
        a, b = ids[i + n : i + n + step], ids[j + n : j + n + step]
        other = np.flatnonzero(a[: len(b)] != b)
        if len(other):
            return n + int(other[0])
        n += len(b)
        step *= 2
    return n


def _same_behind(ids: np.ndarray, i: int, j: int) -> int:
    """How many words before ``i`` equal those before ``j`` (i < j)."""
    n, step = 0, 32
    while n < i:
        m = min(step, i - n)
        other = np.flatnonzero(ids[i - n - m : i - n] != ids[j - n - m : j - n])
        if len(other):
            return n + m - 1 - int(other[-1])
        n += m
        step *= 2
    return n


def find_runs(ids: np.ndarray, longest: int, *, min_exponent: int = 4, min_length: int = 6) -> list[tuple[int, int, int]]:
    """(start, end, period) of all maximal runs of length >= max(min_length, min_exponent * period), sorted.

    ``ids`` are word numbers; ``longest`` bounds a run's length (that of the longest text). ``min_exponent`` >= 2.
    """
    n = len(ids)
    found: dict[tuple[int, int], int] = {}
    reach, reach_period = np.zeros(n, np.int64), np.ones(n, np.int64)  # of the run over a word that ends last: its end and period
    block = 1
    with np.errstate(over="ignore"):
        hashes = _mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        while min_exponent * (2 * block - 1) <= longest:
            for i, p in zip(*(x.tolist() for x in _caught(hashes, block, min_exponent, reach, reach_period))):
                if reach[i] >= i + p + block and p % reach_period[i] == 0:
                    continue  # inside a run whose period divides this distance
                start = i - _same_behind(ids, i, i + p)
                stop = i + p + _same_ahead(ids, i, i + p)
                if stop - start < max(min_length, min_exponent * p) or (start, stop) in found:
                    continue  # a period of the same stretch found before divides this one
                found[start, stop] = p
                last = reach[start:stop] < stop
                reach[start:stop][last] = stop
                reach_period[start:stop][last] = p
            # the next level's hash joins two neighbours; those over the end hold the last separator and equal no other
            hashes = _mixed(hashes * np.uint64(0xD1342543DE82EF95) + np.roll(hashes, -block) + np.uint64(block))
            block *= 2
    return sorted((s, e, p) for (s, e), p in found.items())


def _caught(hashes: np.ndarray, block: int, min_exponent: int, reach: np.ndarray, reach_period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First blocks of stretches of consecutive blocks caught at one distance, with the distance, by distance.

    A run of ``min_exponent`` periods holds so many whole blocks one behind the other that shorter stretches are left out,
    as are those inside a known run whose period divides the distance.
    """
    low, n = 2 * block - 1, len(hashes)
    needed = max(1, ((min_exponent - 1) * low - block + 1) // block)
    total = max(0, (n - low - block) // block + 1)  # blocks with words at the least distance behind them
    padded = np.concatenate([hashes, np.zeros(2 * low + 2 * block, np.uint64)])
    windows, heads = sliding_window_view(padded, 2 * block)[low::block], hashes[::block]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    step = max(needed + 1, CELLS // (2 * block))
    for at in range(0, total, step):
        # a row before, to see where a stretch begins, and the rows behind that it needs
        lo, hi = max(0, at - 1), min(total, at + step + needed)
        if block <= 8:  # long columns: one at a time
            same = np.empty((2 * block, hi - lo), bool).T
            for c in range(2 * block):
                np.equal(padded[low + c + lo * block :: block][: hi - lo], heads[lo:hi], out=same[:, c])
        else:
            same = windows[lo:hi] == heads[lo:hi, None]
        if not same.any():
            continue
        stretch = same.copy("K")
        for i in range(1, needed):
            stretch[:-i] &= same[i:]
            stretch[max(0, len(same) - i) :] = False
        stretch[1:] &= ~same[:-1]
        c, r = np.nonzero(stretch[at - lo : at - lo + step].T)
        i, p = (r + at) * block, c + low
        new = (i + p + block <= n) & ~((reach[i] >= i + p + block) & (p % reach_period[i] == 0))
        found.append((i[new], p[new]))
    at, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((at, period))
    return at[order], period[order]


def _numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of the texts, their numbers behind one another with a separator after each text, and where the texts begin."""
    words = [t.translate(_BLANKS).split() for t in texts]
    number: defaultdict[bytes, int] = defaultdict(count(len(texts)).__next__)
    sizes = np.array([len(w) + 1 for w in words])
    ids = np.empty(int(sizes.sum()), np.int64)
    begins = np.cumsum(sizes) - sizes
    for i, (w, at) in enumerate(zip(words, begins.tolist())):
        ids[at : at + len(w)] = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
        ids[at + len(w)] = i
    return words, ids, begins


def periodic_runs(df: DataFrame, *, min_exponent: int = 4, min_length: int = 6, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = True) -> DataFrame:
    """The maximal runs of words in each text, and the text without repeats.

    A run is a stretch with smallest period q (words q apart are equal) of at least ``min_length`` words and ``min_exponent``
    periods that keeps the period no further on either side. A word is dropped if a run has it behind its first q words.

    Returns the columns ``keep``, ``n_words``, ``n_runs``, ``runs`` (array of start, length, period; by start, then
    period), ``start``, ``length``, ``period``, ``exponent_milli`` of the run with the greatest length / period (ties: least start,
    then period; null without a run), ``runs_sha256`` (of `start,length,period` lines), ``collapsed_sha256`` and, unless
    ``with_text`` is false, ``collapsed`` (the kept words joined by one space).

    A null or blank text has no words and no runs. Repeated rows come back each; an empty table gives none; other columns
    are not read. A text is held whole by its task, at about fifty bytes a word.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("min_exponent >= 2 and min_length >= 1")

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [v.as_py() for v in batch.column(batch.num_columns - 1).cast(pa.binary())]
        words, ids, begins = _numbered(texts)
        by_text: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        longest = max(map(len, words), default=0)
        all_runs = find_runs(ids, longest, min_exponent=min_exponent, min_length=min_length)
        owner = np.searchsorted(begins, [r[0] for r in all_runs], "right") - 1
        for (start, stop, period), i in zip(all_runs, owner.tolist()):
            by_text[i].append((start - int(begins[i]), stop - start, period))
        out: dict[str, list] = {name: [] for name in ("n_words", "n_runs", "runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed")}
        for own, found in zip(words, by_text):
            found.sort(key=lambda r: (r[0], r[2]))
            best = None
            for r in found:  # exact: length / period by cross multiplication
                if best is None or r[1] * best[2] > best[1] * r[2]:
                    best = r
            kept = own
            if found:
                stays = np.ones(len(own), bool)
                for start, length, period in found:
                    stays[start + period : start + length] = False
                kept = [w for w, s in zip(own, stays.tolist()) if s]
            collapsed = b" ".join(kept)
            lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
            values = (len(own), len(found), [dict(zip(("start", "length", "period"), r)) for r in found], *(best or (None,) * 3), best and 1000 * best[1] // best[2])
            values += (hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest(), collapsed if with_text else None)
            for column, value in zip(out.values(), values):
                column.append(value)
        if not with_text:
            del out["collapsed"]
        long = pa.int64()
        kinds = {"runs": pa.list_(pa.struct([("start", long), ("length", long), ("period", long)])), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}
        made = [pa.array(v, pa.binary()).cast(pa.string()) if k == "collapsed" else pa.array(v, kinds.get(k, long)) for k, v in out.items()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + GROUP_BYTES)))
                yield of_batch(batch.slice(at, to - at))
                at = to

    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    fields += ["n_words long", "n_runs long", "runs array<struct<start: long, length: long, period: long>>", "start long", "length long", "period long", "exponent_milli long", "runs_sha256 string", "collapsed_sha256 string"]
    return over_arrow(df.select(*keep, text_of(text).alias("__text")), run, ", ".join(fields + ["collapsed string"] * with_text))


def with_planted_runs(df: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` where the text of every tenth row (h = crc32 of the id, h % 10 = 0) goes over into a repetition.

    With g = floor(h / 10), each word i from a = g % n on becomes word a + (i - a) % p, where p = 1 + floor((n - a) / (3 + g % 8)).
    Other texts, and those without words or with a null id, stay.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    blank = r"[ \t-\r]+"
    words = F.array_remove(F.split(text, blank), "")
    n, g = F.size("__w").cast("long"), F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    some = df.withColumn("__w", F.when(F.pmod(h, F.lit(10)) == 0, words)).withColumn("__a", F.when(n > 0, a).cast("int")).withColumn("__p", F.when(n > 0, p).cast("int"))
    times = (F.size("__w") - F.col("__a")) / F.col("__p")
    tail = F.flatten(F.array_repeat(F.slice("__w", F.col("__a") + 1, F.col("__p")), F.ceil(times).cast("int")))
    edited = F.concat(F.slice("__w", F.lit(1), F.col("__a")), F.slice(tail, F.lit(1), F.size("__w") - F.col("__a")))
    return some.withColumn(text, F.when(F.size("__w") > 0, F.array_join(edited, " ")).otherwise(F.col(text))).drop("__w", "__a", "__p")
