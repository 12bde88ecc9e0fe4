"""Collocations: phrases that recur, scored by how much oftener their parts meet than they would apart.

Counting is a HAT-trie in each task: a shallow trie of word ids whose leaves are hash containers. A container holds the
phrases of a range of sibling words; one that outgrows ``BURST`` entries bursts, into two halves of its range or, once it
holds a single word, into a node of the next word. Only the longest phrase that begins at each word is put in; shorter
ones are sums over subtrees. Beyond ``ENTRIES`` the largest subtrees leave whole, as runs sorted by phrase. Spark deals
the runs out by their prefix, the first two words, and merges them; a pass over the merged rows sums phrases of every
length. Prefixes that very many words follow are dealt out by the third word too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm._shared import over_arrow, stored, text_of

#: Entries of a container before it bursts.
BURST = 1 << 16
#: Entries of all tries of a task (about 120 bytes each) and bytes of its vocabulary, before subtrees leave.
ENTRIES, VOCABULARY_BYTES = 1_500_000, 64 << 20
#: Languages with a trie of their own in a task; beyond, all leave.
TRIES = 64
#: Bytes that are split into words at a time.
CHUNK = 4 << 20
#: Prefixes of which the words that follow are dealt out in ``SPLITS`` parts: the ``BUSY`` ones that at least ``FOLLOWED``
#: words follow in the beginnings of the first ``SAMPLE`` documents.
BUSY, SPLITS, FOLLOWED, SAMPLE, SAMPLE_LETTERS = 4096, 64, 50, 2000, 20_000
#: Rows of sorted runs that are summed at a time.
MERGED = 1 << 15
#: The split of rows that hold sums of first words.
FIRST = -1
#: Groups of a language's phrases that are cut to the first ``top`` before the language is.
GROUPS = 64
#: What ends a piece, and what stands between words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PLAIN = bytes.maketrans(_UPPER + PIECE_ENDS + BLANKS, _UPPER.lower() + b"." * len(PIECE_ENDS) + b" " * len(BLANKS))
_END = b"."


class Node:
    """Children of one trie node: child i holds phrases whose word at ``depth`` is from lows[i] up to lows[i + 1]."""

    def __init__(self, depth: int, kid: dict[int, int]):
        self.depth, self.lows, self.kids = depth, [0], [kid]

    def parts(self) -> Iterator[dict[int, int]]:
        for kid in self.kids:
            yield from kid.parts() if isinstance(kid, Node) else (kid,)


class HatTrie:
    """Counts of phrases of up to ``words`` word ids, packed in 64 bits with the first word highest; 0 stands after a piece's end."""

    def __init__(self, words: int, bits: int):
        self.bits, self.mask = bits, (1 << bits) - 1
        self.shifts = [bits * (words - 1 - i) for i in range(words)]
        self.root, self.entries = Node(0, {}), 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """``keys`` sorted and distinct."""
        self._add(self.root, keys, counts)

    def _add(self, node: Node, keys: np.ndarray, counts: np.ndarray) -> None:
        ids = (keys >> self.shifts[node.depth]) & self.mask
        cuts = [0, *np.searchsorted(ids, node.lows[1:]).tolist(), len(keys)]
        for i in reversed(range(len(node.kids))):  # bursts only move what lies behind
            if cuts[i] == cuts[i + 1]:
                continue
            kid, part = node.kids[i], slice(cuts[i], cuts[i + 1])
            if isinstance(kid, Node):
                self._add(kid, keys[part], counts[part])
                continue
            before = len(kid)
            for key, n in zip(keys[part].tolist(), counts[part].tolist()):
                kid[key] = kid.get(key, 0) + n
            self.entries += len(kid) - before
            if len(kid) > BURST:
                self._burst(node, i)

    def _burst(self, node: Node, i: int) -> None:
        held = node.kids[i]
        keys = np.fromiter(held, np.int64, len(held))
        ids = (keys >> self.shifts[node.depth]) & self.mask
        low, middle = int(ids.min()), int(np.partition(ids, len(ids) // 2)[len(ids) // 2])
        if low == int(ids.max()):
            below = Node(node.depth + 1, held)
            node.kids[i] = below
            # other words of the range get containers of their own
            node.lows[i + 1 : i + 1], node.kids[i + 1 : i + 1] = [low + 1], [{}]
            if low > node.lows[i]:
                node.lows[i + 1 : i + 1], node.kids[i : i + 1] = [low], [{}, below]
            self._burst(below, 0)
            return
        cut = middle if middle > low else middle + 1
        right = {k: held.pop(k) for k in keys[ids >= cut].tolist()}
        node.lows[i + 1 : i + 1], node.kids[i + 1 : i + 1] = [cut], [right]
        for j in (i + 1, i):
            if len(node.kids[j]) > BURST:
                self._burst(node, j)

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes the root's largest subtrees out until ``keep`` entries stay: their keys and counts."""
        sizes = [sum(map(len, kid.parts())) if isinstance(kid, Node) else len(kid) for kid in self.root.kids]
        taken: list[dict[int, int]] = []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            if self.entries <= keep:
                break
            kid = self.root.kids[i]
            taken += kid.parts() if isinstance(kid, Node) else [kid]
            self.root.kids[i] = {}
            self.entries -= sizes[i]
        n = sum(map(len, taken))
        keys = np.fromiter((k for d in taken for k in d), np.int64, n)
        return keys, np.fromiter((c for d in taken for c in d.values()), np.int64, n)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ``keys`` once each, with the sums of their counts."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


class PhraseCounts:
    """The tries of one task, by language; phrases come out as runs sorted by phrase. ``busy``: prefixes whose runs are split."""

    def __init__(self, words: int, busy: list[tuple[str, bytes, bytes]]):
        self.words, self.bits, self.busy = words, 63 // words, busy
        self.mask = (1 << self.bits) - 1
        self.chunk = min(CHUNK, 1 << self.bits)
        self.tries: dict[str, HatTrie] = {}
        self.waiting: dict[str, list[bytes]] = {}
        self.waiting_bytes: dict[str, int] = {}
        self.carried: dict[str, list[bytes]] = {}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {_END: 0}
        self.known_bytes = 0

    def text(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        if lang not in self.waiting and len(self.waiting) >= TRIES:
            yield from self.close()
        self.waiting.setdefault(lang, []).extend((text, _END))
        self.waiting_bytes[lang] = self.waiting_bytes.get(lang, 0) + len(text) + 1
        if self.waiting_bytes[lang] >= self.chunk:
            yield from self._count(lang, False)

    def _count(self, lang: str, last: bool) -> Iterator[pa.RecordBatch]:
        data = b"".join(self.waiting[lang]).translate(_PLAIN)
        self.waiting[lang], self.waiting_bytes[lang] = [], 0
        at = 0
        while at < len(data):
            to = min(len(data), at + self.chunk)
            if to < len(data):  # whole words
                cut = max(data.rfind(b" ", at, to), data.rfind(_END, at, to))
                cut = cut if cut > at else min((x for x in (data.find(b" ", to), data.find(_END, to)) if x >= 0), default=len(data) - 1)
                to = cut + 1
            yield from self._words(lang, data[at:to])
            at = to
        if last:
            yield from self._words(lang, _END * (self.words - 1))
            self.carried.pop(lang, None)

    def _words(self, lang: str, data: bytes) -> Iterator[pa.RecordBatch]:
        data = b" ".join([*self.carried.get(lang, ()), data.replace(_END, b" . ").strip(b" ")])
        text = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(data)], np.int32)), pa.py_buffer(data))
        words = pc.ascii_split_whitespace(text).flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_pylist()
        fresh = [w for w in distinct if w not in self.known and w]
        if len(self.known) + len(fresh) > self.mask or self.known_bytes > VOCABULARY_BYTES:
            yield from self._leave(0)
            self._forget()
            fresh = [w for w in distinct if w != _END and w]
        self.known.update(zip(fresh, count(len(self.known))))
        self.known_bytes += sum(map(len, fresh))
        at = np.fromiter((self.known[w] if w else -1 for w in distinct), np.int64, len(distinct))
        ids = at[words.indices.to_numpy()]
        ids = ids[ids >= 0]
        whole = max(0, len(ids) - self.words + 1)  # first words whose longest phrase is at hand
        spelt = dict(zip(at.tolist(), distinct))
        self.carried[lang] = [spelt[i] for i in ids[whole:].tolist()]
        key = np.zeros(whole, np.int64)
        going = np.ones(whole, bool)
        for i in range(self.words):
            word = ids[i : i + whole]
            going &= word > 0
            key = key << self.bits | np.where(going, word, 0)
        keys, counts = np.unique(key[key > 0], return_counts=True)
        if len(keys):
            if lang not in self.tries:
                self.tries[lang] = HatTrie(self.words, self.bits)
            self.tries[lang].add(keys, counts)
        if sum(t.entries for t in self.tries.values()) > ENTRIES:
            yield from self._leave(ENTRIES // 2)

    def _leave(self, keep: int) -> Iterator[pa.RecordBatch]:
        for lang, trie in sorted(self.tries.items(), key=lambda x: -x[1].entries):
            others = sum(t.entries for t in self.tries.values()) - trie.entries
            if trie.entries and trie.entries + others > keep:
                yield from self._run(lang, *trie.spill(max(0, keep - others)))
        self.tries = {lang: t for lang, t in self.tries.items() if t.entries}

    def _run(self, lang: str, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The run of some subtrees: sums of first words, and phrases of two words or more as prefix and rest."""
        spelt = list(self.known)
        word = lambda k, i: (k >> self.bits * (self.words - 1 - i)) & self.mask  # noqa: E731  the i-th
        used = np.unique(np.concatenate([word(keys, i) for i in range(self.words)]))
        names = sorted(spelt[i] for i in used[used > 0].tolist())
        rank = np.zeros(len(spelt), np.int64)
        rank[[self.known[w] for w in names]] = np.arange(1, len(names) + 1)
        ranked = np.zeros(len(keys), np.int64)
        for i in range(self.words):
            ranked = ranked << self.bits | rank[word(keys, i)]
        order = np.argsort(ranked)
        ranked, counts = ranked[order], counts[order]
        spellings = pa.array([b"", *names], pa.binary()).cast(pa.string())
        spelling = lambda k, i: spellings.take(pa.array(word(k, i)))
        firsts, sums = _summed(ranked >> self.bits * (self.words - 1), counts)
        none = [""] * (self.words - 2)
        yield from _rows(lang, FIRST, spellings.take(pa.array(firsts)), none, sums)
        yield from _rows(lang, FIRST, pa.array([""]), none, np.array([counts.sum()]))
        longer = word(ranked, 1) > 0
        ranked, counts = ranked[longer], counts[longer]
        prefix = pc.binary_join_element_wise(spelling(ranked, 0), spelling(ranked, 1), " ")
        split = np.zeros(len(ranked), np.int32)
        if self.words > 2:
            rank_of = lambda w: int(rank[self.known.get(w, 0)])
            pairs = [rank_of(a) << self.bits | rank_of(b) for of, a, b in self.busy if of == lang]
            hit = np.isin(ranked >> self.bits * (self.words - 2), pairs)
            part_of = np.array([1 + crc32(w) % SPLITS for w in (b"", *names)], np.int32)
            split[hit] = part_of[word(ranked[hit], 2)]
        yield from _rows(lang, split, prefix, [spelling(ranked, i) for i in range(2, self.words)], counts)

    def close(self) -> Iterator[pa.RecordBatch]:
        for lang in list(self.waiting):
            yield from self._count(lang, True)
        yield from self._leave(0)
        self.waiting.clear()
        self.waiting_bytes.clear()


def _rows(lang: str, split, prefix: pa.Array, rest: list, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = len(prefix)
    whole = lambda x, kind: pa.repeat(pa.scalar(x, kind), n) if isinstance(x, int | str) else pa.array(x, kind)
    cols = [prefix, whole(split, pa.int32()), whole(lang, pa.string()), *(whole(r, pa.string()) for r in rest), pa.array(counts, pa.int64())]
    table = pa.RecordBatch.from_arrays(cols, names=[*_key(len(rest) + 2), "a"])
    for at in range(0, n, 1 << 16):
        yield table.slice(at, 1 << 16)


def _key(words: int) -> list[str]:
    """The columns of a run's key: prefix, split and language, and the words behind the prefix ("" behind a piece's end)."""
    return ["prefix", "split", "lang", *(f"w{i}" for i in range(3, words + 1))]


def _merged(batches: Iterator[pa.RecordBatch], words: int, min_count: int) -> Iterator[pa.RecordBatch]:
    """Sums of sorted runs, for every length: lang, phrase, a, whole (false: the sum of one split of a prefix)."""
    open_: dict[int, tuple[tuple, int]] = {}
    names = _key(words)

    def frequent(n: int, keys: list[pa.Array], sums: np.ndarray) -> pa.RecordBatch:
        split = keys[1].to_numpy()
        kept = sums >= min_count
        if n == 2:
            kept |= (split > 0) | pc.equal(keys[0], "").to_numpy(zero_copy_only=False)
        else:
            kept &= pc.not_equal(keys[-1], "").to_numpy(zero_copy_only=False)
        keys, at = [k.filter(pa.array(kept)) for k in keys], np.flatnonzero(kept)
        phrase = pc.binary_join_element_wise(keys[0], *keys[3:], " ") if n > 2 else keys[0]
        whole = pa.array(split[at] <= 0) if n == 2 else pa.repeat(True, len(at))
        return pa.RecordBatch.from_arrays([keys[2], phrase, pa.array(sums[at]), whole], names=["lang", "phrase", "a", "whole"])

    def alone(n: int, key: tuple, total: int) -> pa.RecordBatch:
        return frequent(n, [pa.array([v], pa.int32() if i == 1 else pa.string()) for i, v in enumerate(key)], np.array([total]))

    for table in _gathered(batches):
        a = table.column("a").to_numpy()
        changed = np.zeros(len(a) - 1, bool)
        for i, name in enumerate(names):
            column = table.column(name)
            changed |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            n = i  # the words that a phrase of these columns has
            if n < 2:
                continue
            starts = np.r_[0, np.flatnonzero(changed) + 1]
            sums = np.add.reduceat(a, starts)
            at = lambda j, i=i: tuple(table.column(c)[j].as_py() for c in names[: i + 1])
            if n in open_:
                key, total = open_[n]
                if key == at(0):
                    sums[0] += total
                else:
                    yield alone(n, key, total)
            open_[n] = at(int(starts[-1])), int(sums[-1])
            if len(starts) > 1:
                yield frequent(n, [table.column(c).take(pa.array(starts[:-1])) for c in names[: i + 1]], sums[:-1])
    for n, (key, total) in open_.items():
        yield alone(n, key, total)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to ``MERGED`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch] * (batch.num_rows > 0)
        if sum(b.num_rows for b in held) >= MERGED:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _named(df: DataFrame, lang: str, text: str) -> DataFrame:
    return df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).alias("text"))


def busy_prefixes(named: DataFrame) -> list[tuple[str, bytes, bytes]]:
    """The pairs of words that most words follow in the first ``SAMPLE`` documents, at most ``BUSY``.

    They only decide which prefixes are dealt to more than one partition; results do not depend on them.
    """
    pieces = F.split(F.substring(F.lower("text"), 1, SAMPLE_LETTERS), r"[.,;:!?\x0A-\x0D]")
    words = named.limit(SAMPLE).select("lang", F.explode(pieces).alias("piece")).select("lang", F.split(F.trim(F.translate("piece", "\t", " ")), " +").alias("w"))
    pairs = words.where(F.size("w") > 2).select("lang", F.explode(F.arrays_zip(F.expr("slice(w, 1, size(w) - 2)").alias("a"), F.expr("slice(w, 2, size(w) - 2)").alias("b"), F.expr("slice(w, 3, size(w) - 2)").alias("c"))).alias("t"))
    followed = pairs.groupBy("lang", "t.a", "t.b").agg(F.count_distinct("t.c").alias("n")).where(F.col("n") >= FOLLOWED)
    return [(r.lang, r.a.encode(), r.b.encode()) for r in followed.orderBy(F.desc("n"), "lang", "a", "b").limit(BUSY).collect()]


def phrase_counts(df: DataFrame, *, max_words: int, min_count: int, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, phrase, words, a: phrases of 1 to ``max_words`` words that occur ``min_count`` times; the empty phrase counts all words."""
    named = _named(df, lang, text)
    busy = busy_prefixes(named) if max_words > 2 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = PhraseCounts(max_words, busy)
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                yield from held.text(name, value.as_py())
        yield from held.close()

    keys = _key(max_words)
    schema = ", ".join(f"{k} {'int' if k == 'split' else 'string'}" for k in keys)
    runs = over_arrow(named, run, f"{schema}, a long").repartition("prefix", "split", "lang").sortWithinPartitions(*keys)
    rows = over_arrow(runs, lambda batches: _merged(batches, max_words, min_count), "lang string, phrase string, a long, whole boolean")
    rows = stored(rows, "phrases")
    split = rows.where("not whole").groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)
    return rows.where("whole").drop("whole").unionByName(split).withColumn("words", F.when(F.col("phrase") == "", 0).otherwise(_n_words("phrase")))


def _n_words(phrase: str) -> F.Column:
    return F.when(F.col(phrase) == "", 0).otherwise(F.length(phrase) - F.length(F.replace(F.col(phrase), F.lit(" "), F.lit(""))) + 1)


def collocations(df: DataFrame, *, min_words: int = 2, max_words: int = 3, min_count: int = 10, share: int = 50, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """The first ``top`` phrases of ``min_words`` to ``max_words`` words of each language.

    Returns ``lang``, ``rank`` (int, from 1), ``phrase``, ``a`` (its count), ``l`` and ``r`` (counts of both parts at the
    cut with the lowest score; ties to the earliest), ``n`` (the language's words), ``score`` = floor(10^6 a^2 / (l r)).
    Letters A-Z count as a-z. Phrases do not cross the ends of pieces (.,;:!? and line ends) or documents. Candidates
    occur ``min_count`` times; one whose words lie in a longer candidate with at least ``share`` percent of its count is
    left out. Order: score, count, phrase (byte order).

    A null text is empty; a null language is ``und``. Documents repeated count each time. A language without candidates
    has no rows; an empty table gives none. Other columns are not read. ``max_words`` is 2 to 4 (ids are packed in 64
    bits), ``min_words`` 2 to ``max_words``. A single word longer than an Arrow batch is held whole.
    """
    if not 2 <= min_words <= max_words <= 4 or min_count < 1:
        raise ValueError("2 <= min_words <= max_words <= 4 and min_count >= 1")
    counts = stored(phrase_counts(df, max_words=max_words, min_count=min_count, lang=lang, text=text), "counts")
    candidates = counts.where(F.col("words").between(min_words, max_words))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    parts = counts.where("words between 1 and %d" % (max_words - 1))
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    exact = "cast(cast(1000000 as decimal(7, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) as decimal(38, 0)) div (cast(l as decimal(15, 0)) * cast(r as decimal(15, 0)))"
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", F.expr(exact).cast("long"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(%d, words - 1), m -> transform(sequence(0, words - m), i -> array_join(slice(split(phrase, ' '), i + 1, m), ' '))))" % min_words)
    longer = candidates.where(F.col("words") > min_words).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    alone = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("within").isNull() | (100 * F.col("within") < share * F.col("a")))
    rows = alone.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS)).alias("group"))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("phrase = ''").select("lang", F.col("a").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), words as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), grams as (
  select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) as phrase
  from words, (values (1), (2), (3)) as t(m)
  where len(w) >= m
), f as (
  select lang, m, phrase, count(*) as a from grams group by all
), total as (
  select lang, sum(a) as n from f where m = 1 group by lang
), c as (
  select * from f where m >= 2 and a >= 10
), cuts as (
  select c.*, k, string_split(phrase, ' ') as w from c, (values (1), (2)) as t(k) where k < m
), scored as (
  select c.lang, c.m, c.phrase, c.a, c.k, x.a as l, y.a as r,
    cast((1000000::hugeint * c.a * c.a) // (x.a::hugeint * y.a) as bigint) as score
  from cuts c
  join f x on x.lang = c.lang and x.m = c.k and x.phrase = array_to_string(c.w[1 : c.k], ' ')
  join f y on y.lang = c.lang and y.m = c.m - c.k and y.phrase = array_to_string(c.w[c.k + 1 : c.m], ' ')
), lowest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), longer as (
  select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, a
  from (select lang, a, string_split(phrase, ' ') as w from c where m = 3)
), kept as (
  select * from lowest s
  where m = 3 or not exists (select 1 from longer g where g.lang = s.lang and g.phrase = s.phrase and 100 * g.a >= 50 * s.a)
), ranked as (
  select *, cast(row_number() over (partition by lang order by score desc, a desc, phrase) as integer) as rank from kept
)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score
from ranked join total using (lang) where rank <= 2000
"""
