"""Toxicity scores: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression.

Features are densities of lexicon words, their distance to second-person words, and rates of capitals, punctuation and
obfuscated words. Two lexicons feed them: the fixed insults below, and word beginnings whose documents are labelled
toxic far more often than others. The lexicon is learned from at most ``LEXICON_FIT_ROWS`` labelled rows, the trees from at most
``FIT_ROWS``, the calibration from as many others (uniform samples by hash), so that labels can be broadcast and texts are
never shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm._shared import PerWorker, over_arrow, stored, text_of

FIT_ROWS = 20_000
#: Labelled rows from which the lexicon is learned at most; their labels (12 bytes each) are broadcast to the texts.
LEXICON_FIT_ROWS = 50_000
#: Entries of the learned lexicon at most; it is broadcast.
LEXICON_ROWS = 5_000
#: Lengths of word beginnings that the lexicon counts; whole words count up to the last length.
STEMS = (4, 5, 6, 8, 12)
CACHE_WORDS = 300_000
#: Documents near a second-person word: this many words on either side.
NEAR = 4

#: Common insults and second-person words of the four languages.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown fool fools imbecile cretin retard jerk creep filth vermin pig ugly hate kill dummkopf blöd arschloch abschaum müll wertlos ekelhaft versager trottel widerlich estúpido estúpida imbécil basura asqueroso inútil tonto perdedor payaso asco stupide idiote crétin débile ordure nul minable dégoûtant abruti connard".split())
SECOND = frozenset("you your yours yourself u ur ya du dich dir dein deine deiner ihr euch euer sie tú tu ti te usted ustedes vosotros tus vous toi votre vos ton ta tes".split())
_LEET = str.maketrans("0134578@$!|€", "oleastbasiie")
_EDGE = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x40), *range(0x5B, 0x61), *range(0x7B, 0x7F)])) + "¡¿«»“”„’‘…"
NAMES = ("fixed", "learned", "learned_log", "strongest", "evidence", "near_second", "second", "capitals", "shouted", "exclaims", "asks", "punctuation", "obfuscated", "repeated", "digits", "foreign", "length")


def plain(word: str) -> tuple[str, bool]:
    """A word in lower case without marks at its ends, and with look-alikes and marks inside undone; True if any were."""
    bare = word.strip(_EDGE).lower()
    if bare.isalpha() or not any(c.isalpha() for c in bare):
        return bare, False
    undone = "".join(c for c in bare.translate(_LEET) if c.isalpha())
    return undone, undone != bare


def stems(word: str) -> set[str]:
    """A word's counted beginnings; the whole word is marked by its end."""
    return {word[:n] for n in STEMS if len(word) > n} | ({word + "$"} if 3 <= len(word) <= STEMS[-1] else set())


class WordMarks(dict):
    """Maps a word to (fixed insult, learned weight, second person, obfuscated, repeats a letter)."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple:
        if len(self) >= CACHE_WORDS:
            self.clear()
        bare, odd = plain(word)
        weight = max((self.lexicon.get(s, 0.0) for s in stems(bare)), default=0.0) if self.lexicon else 0.0
        fixed = bare in INSULTS
        repeat = any(a == b == c for a, b, c in zip(bare, bare[1:], bare[2:]))
        self[word] = marks = (fixed, weight, bare in SECOND, odd and (fixed or weight > 0), repeat) if fixed or weight or repeat or bare in SECOND else ()
        return marks


def features(text: str, marks: WordMarks) -> list[float]:
    words = text.split()
    n = len(words) or 1
    at = [(i, m) for i, m in enumerate(map(marks.__getitem__, words)) if m]
    hits = [i for i, m in at if m[0] or m[1]]
    second = [i for i, m in at if m[2]]
    weights = [m[1] for _, m in at if m[1]]
    near = 0
    if hits and second:
        s = np.array(second)
        where = np.searchsorted(s, hits)
        gaps = np.minimum(np.abs(s[np.minimum(where, len(s) - 1)] - hits), np.abs(s[np.maximum(where - 1, 0)] - hits))
        near = int((gaps <= NEAR).sum())
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = int(counts.sum()) or 1
    upper, lower, digits = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())
    marked = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    return [
        sum(m[0] for _, m in at) / n,
        len(weights) / n,
        float(np.log1p(len(weights))),
        max(weights, default=0.0),
        min(sum(weights), 30.0),
        near / n,
        len(second) / n,
        upper / size,
        upper / (upper + lower + 1),
        int(counts[33]) / n,
        int(counts[63]) / n,
        marked / size,
        sum(bool(m[3]) for _, m in at) / n,
        sum(bool(m[4]) for _, m in at) / n,
        digits / size,
        int(counts[128:].sum()) / size,
        float(np.log1p(len(words))),
    ]


def part(doc_id) -> int:
    """crc32 of the id as text, mod 4: 2 is held out, 1 calibrates, 0 and 3 teach the trees."""
    return zlib.crc32(str(doc_id).encode()) % 4


def learned_lexicon(labelled: DataFrame, most: int = LEXICON_ROWS) -> DataFrame:
    """stem, weight: word beginnings that mark toxic documents, over all rows of ``labelled`` (text, toxic).

    Each task counts documents by stem before the shuffle. The weight is the lower bound (about two standard errors) of
    the log-odds against the base rate; only bounds over 1 stay, the ``most`` strongest by weight and support.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, toxic = Counter(), Counter()
        kept: dict[str, set[str]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.int64()), pa.array([toxic[s] for s in rows], pa.int64())], names=["stem", "n", "t"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: set[str] = set()
                for word in set(text.split()):
                    if (found := kept.get(word)) is None:
                        if len(kept) >= CACHE_WORDS:
                            kept.clear()
                        kept[word] = found = stems(plain(word)[0])
                    own |= found
                rows.update(own)
                if label == 1:
                    toxic.update(own)
            if len(rows) > 500_000:
                yield out()
                rows.clear()
                toxic.clear()
        yield out()

    counted = over_arrow(labelled.select("text", F.col("toxic").cast("int")), count, "stem string, n long, t long").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where("t >= 3")
    totals = labelled.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic_rows"))
    z = 2.0
    p = F.col("t") / F.col("n")
    low = (p + z * z / (2 * F.col("n")) - z * F.sqrt(p * (1 - p) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (1 + z * z / F.col("n"))
    base = (F.col("toxic_rows") + 1) / (F.col("rows") + 2)
    odds = F.log(low / (1 - low)) - F.log(base / (1 - base))
    weighed = counted.join(F.broadcast(totals)).withColumn("weight", odds)  # totals: one row
    return weighed.where("weight > 1").select("stem", "weight", "n").orderBy(F.desc(F.col("weight") * F.log(F.col("n") + 1)), "stem").limit(most)


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    shared = PerWorker(docs.sparkSession, lexicon, WordMarks)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.get()
        for batch in batches:
            ids = batch.column(0)
            rows = [features(t, marks) for t in batch.column(1).to_pylist()]
            cols = [ids, batch.column(2), pa.array([part(i) for i in ids.to_pylist()], pa.int32()), *(pa.array(list(c) if rows else [], pa.float64()) for c in (zip(*rows) if rows else [[]] * len(NAMES)))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "part", *NAMES])

    return over_arrow(docs.select("doc_id", "text", "key"), run, f"doc_id {kind}, key long, part int, " + ", ".join(f"{n} double" for n in NAMES))


def bounded(labels: DataFrame, rows: int) -> DataFrame:
    """At most about ``rows`` rows, uniform by a hash of the id."""
    n = labels.count()
    return labels if n <= rows else labels.where(F.pmod(F.xxhash64("l_id", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * rows / n))


def toxicity(df: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, lexicon_fit_rows: int = LEXICON_FIT_ROWS, lexicon_rows: int = LEXICON_ROWS) -> DataFrame:
    """Score every whole text of ``df``.

    ``labels`` has ``doc_id`` and ``toxic`` (0 or 1); only rows whose crc32(doc_id as text) mod 4 is not 2 teach.
    Returns ``doc_id``, ``key`` (hash of the text), ``held_out``, ``score`` (0 to 1), ``predicted`` (int) and ``raw``,
    the trees' probability before calibration.

    The model is fitted on bounded samples of labels: trees and calibration on about ``fit_rows`` each, the lexicon of
    word beginnings on about ``lexicon_fit_rows``, of which its ``lexicon_rows`` strongest entries are kept; the lexicon is
    collected and broadcast, so raise that only as far as a worker can hold. Every document is scored.

    Null texts count as empty and are scored. Null ids are scored and teach nothing. Null labels and labels without a
    document teach nothing; a document labelled both ways teaches both. If one class is missing, all scores are the
    share of toxic labels. Repeated rows have a result each. An empty table gives none. Other columns are not read.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("key"), text_of(text_col).alias("text"))
    known = labels.select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).where("l_id is not null and toxic in (0, 1)").distinct()
    part_of = F.pmod(F.crc32(F.col("l_id").cast("string")), F.lit(4))
    teach = stored(known.withColumn("l_part", part_of).where("l_part <> 2"), "labels")
    own = teach.where("l_part <> 1")
    lexicon_labels = F.broadcast(bounded(own, lexicon_fit_rows))
    learned = learned_lexicon(docs.join(lexicon_labels, docs.doc_id == lexicon_labels.l_id).select("text", "toxic"), lexicon_rows)
    lexicon = {r.stem: r.weight for r in learned.collect()}
    scored = stored(with_features(docs, lexicon), "features")
    sampled = F.broadcast(bounded(own, fit_rows).union(bounded(teach.where("l_part = 1"), fit_rows)))
    taught = stored(scored.join(sampled, scored.doc_id == sampled.l_id).drop("l_id").withColumn("label", F.col("toxic").cast("double")), "taught")
    classes = {r.label: r["count"] for r in taught.groupBy("label").count().collect()}
    held = F.col("part") == 2
    if len(classes) < 2:
        share = F.lit(classes.get(1.0, 0) / max(1, sum(classes.values())))
        return scored.select("doc_id", "key", held.alias("held_out"), share.alias("score"), (share >= threshold).cast("int").alias("predicted"), share.alias("raw"))
    assemble = VectorAssembler(inputCols=list(NAMES), outputCol="features")
    trees_on = taught.where("l_part <> 1") if taught.where("l_part <> 1").select("label").distinct().count() == 2 else taught
    sample = assemble.transform(trees_on).select("features", "label").coalesce(6)
    trees = GBTClassifier(maxIter=12, maxDepth=3, maxBins=64, stepSize=0.3, seed=11, cacheNodeIds=False).fit(sample)

    def raw(x: DataFrame) -> DataFrame:
        return trees.transform(assemble.transform(x)).withColumn("raw", vector_to_array("probability")[1])

    check_on = taught.where("l_part = 1") if taught.where("l_part = 1").select("label").distinct().count() == 2 else taught
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(raw(check_on).select("raw", "label").coalesce(6))
    out = curve.transform(raw(scored).select("doc_id", "key", "part", "raw"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return out.select("doc_id", "key", held.alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "raw")
