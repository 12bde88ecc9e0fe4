"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A document is the multiset of its words. Each distinct word w with count x is drawn in every one of ``slots`` slots by
gamma-based samples: with r, c ~ Gamma(2, 1) and b ~ U(0, 1) drawn from the hash of word and slot,
``t = floor(ln x / r + b)``, ``ln y = r (t - b)``, ``ln a = ln c - ln y - r``. The slot keeps (w, t) of the least a. Two
documents keep the same sample in a slot with the probability of their generalised Jaccard similarity, the sum of minima
over the sum of maxima, however skewed their counts are. Texts without words fill no slot.

The least a of a text of n words is exponential with rate n, so samples that are surely over ``SURE / n`` are not worked
out: no slot's sample differs for it, except that a slot stays empty with probability e^-24 (4e-11).

Words of a text and of its edited text are hashed, sorted and counted together by array functions, so that no table of
words is kept and a word that both hold is drawn once. Samples are drawn from exploded counts, in generated code: a row
for each word and lane of slots, an aggregate for each text and slot of the lane. Documents are dealt by ranges of ids into buckets. A sentinel row at each bucket's end holds the text that
follows, so that neighbours meet in a window of one bucket; texts are shuffled once.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm._shared import stored, text_of

#: Buckets: so many quantiles of the ids, each cut into equal steps.
QUANTILES, STEPS = 64, 32
#: A text of n words fills each slot with a sample of a <= SURE / n, but for a probability of e^-SURE.
SURE = 24.0
#: Slots that one row draws, at most: few enough for compiled code, enough to spare rows.
LANE = 4
SPACE = r"[\x20\x09-\x0D]+"


def bucket_of(doc_id: Column, edges: list[float]) -> Column:
    """A number that never falls as the id grows; -1 for null ids."""
    x = doc_id.cast("double")
    known = F.array(*map(F.lit, edges))
    coarse = F.size(F.filter(known, lambda e: e <= x))
    low = F.element_at(known, F.greatest(coarse, F.lit(1)))
    high = F.element_at(known, F.least(coarse + 1, F.lit(len(edges))))
    step = F.when((coarse > 0) & (high > low), F.floor((x - low) / (high - low) * STEPS)).otherwise(0)
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(coarse * STEPS + F.least(step, F.lit(STEPS - 1))).cast("int")


def uniform(bits: Column, third: int) -> Column:
    """A number in (0, 1) from 21 bits of a hash: the first, second or third."""
    own = (F.shiftrightunsigned(bits, 21 * third) if third else bits).bitwiseAND(F.lit((1 << 21) - 1))
    return (own.cast("double") + 0.5) * 2.0**-21


def word_counts(df: DataFrame, text: str, edited: str, out: str) -> DataFrame:
    """Adds ``out``: array of (h, x, y), the hash of each distinct word of either text and its counts in both.

    Hashes give their last bit to the text that they come from, so that sorting puts a word's own runs side by side.
    Columns are added one at a time: each array is used several times, which keeps it from being computed as often.
    """
    none = F.xxhash64(F.lit("")).bitwiseAND(F.lit(-2))  # of the empty strings that splitting leaves at the ends
    words, ends, runs = f"{out}_words", f"{out}_ends", f"{out}_runs"
    hashed = lambda t, side: F.transform(F.split(t, SPACE), lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(side).cast("long")))
    df = df.withColumn(words, F.sort_array(F.concat(hashed(text, 0), hashed(edited, 1))))
    df = df.withColumn(ends, F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: ~F.get(words, i).eqNullSafe(F.get(words, i + 1))))
    run = lambda i, j: F.struct(F.get(words, i).alias("v"), (i - F.coalesce(F.get(ends, j - 1), F.lit(-1))).cast("long").alias("n"))
    df = df.withColumn(runs, F.transform(ends, run))

    def pair(w, j):
        own, before, after = w["v"].bitwiseAND(F.lit(1)) == 0, F.get(runs, j - 1), F.get(runs, j + 1)
        # a run of the edited text is told with that of the text before it, where there is one
        lone = ~own & ~before["v"].eqNullSafe(w["v"] - 1)
        y = F.when(lone, w["n"]).when(own & (after["v"] == w["v"] + 1), after["n"]).otherwise(0)
        return F.struct(w["v"].bitwiseAND(F.lit(-2)).alias("h"), F.when(own, w["n"]).otherwise(0).alias("x"), y.alias("y"))

    return df.withColumn(out, F.filter(F.transform(runs, pair), lambda w: (w["x"] + w["y"] > 0) & (w["h"] != none))).drop(words, ends, runs)


def drawn(words: DataFrame, lane: int) -> DataFrame:
    """Adds r, ln c and b of each word for the slots of its lane ``at``: drawn once, whatever texts hold the word.

    Where ``most`` shows that the word cannot be the least of either text, r and ln c are null and cost no logarithm:
    with c = -ln p1 >= 1 - p1 and e^-r = p0, a count x gives a >= (1 - p1) p0 / x.
    """
    # two hashes have the bits of five numbers
    key = lambda i, j: F.xxhash64(F.col("h").bitwiseXOR(((F.col("at") * lane + i) * 2 + j + 1) * F.lit(0x9E3779B97F4A7)))
    words = words.select("*", *(key(i, j).alias(f"k{j}_{i}") for i in range(lane) for j in (0, 1)))
    product = lambda j, i: uniform(F.col(f"k{j}_{i}"), 0) * uniform(F.col(f"k{j}_{i}"), 1)
    names = ("bucket", "seq", "at", "h", "x", "ln_x", "ln_y")
    words = words.select(
        *(*names, "most"),
        *(product(j, i).alias(f"p{j}_{i}") for i in range(lane) for j in (0, 1)),
        *(uniform(F.col(f"k0_{i}"), 2).alias(f"b{i}") for i in range(lane)),
    )
    may_win = lambda i: (1 - F.col(f"p1_{i}")) * F.col(f"p0_{i}") <= F.col("most")
    return words.select(
        *names,
        *(F.when(may_win(i), -F.log(F.col(f"p0_{i}"))).alias(f"r{i}") for i in range(lane)),
        *(F.when(may_win(i), F.log(-F.log(F.col(f"p1_{i}")))).alias(f"c{i}") for i in range(lane)),
        *(f"b{i}" for i in range(lane)),
    )


def sample(i: int, ln_count: str) -> Column:
    """What ``h`` with a count draws in slot i of its lane: ln a in fixed point above 27 bits that tell (word, t); null without a count."""
    low = F.lit((1 << 27) - 1)
    r, c, b = (F.col(f"{n}{i}") for n in "rcb")
    t = F.floor(F.col(ln_count) / r + b)
    log_a = c - r * (t - b + 1)
    fixed = F.greatest(F.lit(0.0), F.least(F.lit(2.0**30 - 1), (log_a + 128) * 2.0**22)).cast("long")
    told = F.col("h").bitwiseAND(low) + t.bitwiseAND(low) * F.lit(0x4F1BBCD)
    return F.when(F.col(ln_count).isNotNull(), F.shiftleft(fixed, 27).bitwiseOR(told.bitwiseAND(low)))


def likeness(x: str, y: str) -> Column:
    """Share of equal samples among the slots that either fills; 1 for two empty fingerprints."""
    slots = lambda c: F.transform(c, lambda v: F.shiftright(v, 16))
    either = F.size(F.array_union(slots(F.col(x)), slots(F.col(y))))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / either).cast("double")


def text_form(slots: str) -> Column:
    """Six hexadecimal digits for each filled slot: its number and 16 bits of its sample."""
    return F.array_join(F.transform(slots, lambda v: F.lpad(F.lower(F.hex(v)), 6, "0")), "")


def fingerprint_documents(df: DataFrame, *, slots: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likenesses.

    The edited text replaces the last floor(n_chars / 3) code points by the first as many (or all) of the next
    document's, in descending order of ids; the first document follows the last. Returns ``doc_id``, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``.

    Null texts count as empty; texts without words have the empty fingerprint, like each other (1) and unlike all others
    (0). Null ids come last. Rows that share an id are ordered by a hash of their texts; repeated rows follow one
    another and have a result each. A single document follows itself. An empty table gives none. Other columns are not
    read.
    """
    if not 1 <= slots <= 64:
        raise ValueError("slots must be within 1 and 64")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    edges = sorted(set(docs.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / QUANTILES for i in range(QUANTILES + 1)], 1 / (4 * QUANTILES)))) or [0.0]
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("key"), bucket_of(F.col("doc_id"), edges).alias("bucket"))

    # the first document of each bucket, at most QUANTILES * STEPS + 2 rows
    tops = docs.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    tied = docs.join(F.broadcast(tops.withColumnRenamed("bucket", "at")), (F.col("bucket") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("top")))
    least = tied.groupBy("bucket").agg(F.min("key").alias("least"))
    firsts = tied.join(least, "bucket").where("key = least").dropDuplicates(["bucket"]).select("bucket", "text")
    # whose turn comes before: the bucket above; the highest follows the lowest
    turn = Window.orderBy(F.desc("bucket"))
    before = firsts.select("bucket", F.coalesce(F.lag("bucket").over(turn), F.min("bucket").over(Window.partitionBy())).alias("ends"))
    sentinels = firsts.join(before, "bucket").select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("key"), F.col("ends").alias("bucket"), F.col("bucket").alias("next_bucket"))

    rows = docs.withColumn("next_bucket", F.lit(None).cast("int")).unionByName(sentinels)
    order = Window.partitionBy("bucket").orderBy(F.col("next_bucket").isNotNull(), F.desc_nulls_last("doc_id"), "key")
    placed = rows.select("*", F.row_number().over(order).alias("seq"), F.lead("text").over(order).alias("after"), F.lead("next_bucket").over(order).alias("into"))
    own = placed.where("next_bucket is null").withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("after", F.lit(1), cut))
    own = own.select("bucket", "seq", "doc_id", "n_chars", "text", edited.alias("edited"), "into").withColumn("sha", F.sha2("edited", 256))
    own = word_counts(own, "text", "edited", "words")
    # what else a row returns travels as longs in elements of a third kind, numbered by x below 0
    quarter = lambda i: F.conv(F.substring("sha", 1 + 16 * i, 16), 16, -10).cast("long")
    none = F.lit(0).cast("long")
    extra = F.array(*(F.struct(v.cast("long").alias("h"), F.lit(-1 - i).cast("long").alias("x"), none.alias("y")) for i, v in enumerate((F.col("doc_id"), F.col("n_chars"), F.col("into"), *map(quarter, range(4))))))
    # outer: a filter on the array's size would be pushed down and compute it again for each element
    total = lambda n: F.aggregate("words", F.lit(0).cast("long"), lambda acc, w: acc + w[n]).alias(f"all_{n}")
    # in a projection of their own: beside the generator they would be added up again for each element
    own = own.select("*", total("x"), total("y"))
    long = own.select("bucket", "seq", "all_x", "all_y", F.inline_outer(F.concat("words", extra)))
    third = F.col("x") < 0
    share = lambda n: F.coalesce(F.col(n) / F.col(f"all_{n}"), F.lit(0.0))
    lane = gcd(slots, LANE)
    # the logarithm of a count of 0 or below is null
    counted = long.select("*", F.log(F.col("x").cast("double")).alias("ln_x"), F.log(F.col("y").cast("double")).alias("ln_y"), F.when(third, -1.0).otherwise(F.greatest(share("x"), share("y")) * SURE).alias("most"))
    counted = counted.withColumn("at", F.explode(F.when(third, F.array((-1 - F.col("x")).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(slots // lane - 1)))))
    kept = drawn(counted, lane).groupBy("bucket", "seq", "at").agg(F.max(F.when(third, F.col("h"))).alias("told"), *(F.min(sample(i, f"ln_{n}")).alias(f"{n}{i}") for n in "xy" for i in range(lane)))
    values = lambda n: F.filter(F.array(*(F.shiftleft(F.col("at") * lane + i, 16).bitwiseOR(F.col(f"{n}{i}").bitwiseAND(F.lit(0xFFFF))).cast("int") for i in range(lane))), lambda v: v.isNotNull())
    side = lambda n: F.sort_array(F.flatten(F.collect_list(values(n))))
    told = lambda i: F.max(F.when(F.col("at") == i, F.col("told")))
    prints = kept.groupBy("bucket", "seq").agg(told(0).alias("doc_id"), told(1).alias("n_chars"), told(2).cast("int").alias("into"), *(told(3 + i).alias(f"s{i}") for i in range(4)), side("x").alias("a"), side("y").alias("b"))
    prints = prints.withColumn("sha", F.lower(F.concat(*(F.lpad(F.hex(f"s{i}"), 16, "0") for i in range(4))))).drop("s0", "s1", "s2", "s3")
    prints = stored(prints, "fingerprints")
    mine = prints.withColumn("to_bucket", F.coalesce("into", "bucket")).withColumn("to_seq", F.when(F.col("into").isNull(), F.col("seq") + 1).otherwise(1))
    after = prints.select(F.col("bucket").alias("to_bucket"), F.col("seq").alias("to_seq"), F.col("a").alias("c"))
    return mine.join(after, ["to_bucket", "to_seq"]).select(
        "doc_id",
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        text_form("a").alias("fingerprint"),
        text_form("b").alias("edited_fingerprint"),
        likeness("a", "b").alias("near_edited"),
        likeness("a", "c").alias("near_next"),
    )
