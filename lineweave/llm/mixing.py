"""Mixing sources to target weights by entropy balancing.

Document rates minimise the entropy, measured in words, between the mix and the corpus under one constraint for each
source: its words come to its target. The dual is convex; its solution tilts each document's base rate q exponentially,
``rate = min(cap, q * exp(lambda_source))``. Documents enter the dual through their sources' sums for each base rate
alone, so one aggregation over all documents (combined before the shuffle) feeds every Newton step.

Rates become whole copies by error diffusion: within shards of a source, largest documents first, a document takes the
copy above its rate when the words taken so far lag behind. Shards are dealt by a hash of id and text, so a source with
a third of all rows is many groups, and reruns agree.
"""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm._shared import stored

NEWTON_STEPS = 64
#: Base rates are held to this many decimals, under 0.1 to as many significant digits, which bounds the sums of a source.
BASE_DECIMALS = 2
#: Documents of a shard in which copies are rounded together, about.
SHARD_ROWS = 2_000


def word_count(text: str = "text") -> Column:
    r"""Number of runs of ``[^\x20\x09-\x0D]``; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def held(base: Column) -> Column:
    """A base rate as it enters the sums; positive rates stay positive."""
    scale = F.pow(F.lit(10.0), BASE_DECIMALS - 1 - F.floor(F.log10(base)))
    return F.when((base > 0) & (base < 0.1), F.round(base * scale) / scale).otherwise(F.round(base, BASE_DECIMALS))


def source_targets(sizes: DataFrame, cap: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Targets from ``source``, ``source_size`` (one row for each source): adds ``target``.

    Sources in code point order, null last, take ``weights`` in turn and share the sum of all sizes. A target over
    ``cap`` times its source's size stops there and the rest is shared anew, which ends at the level L with
    ``target = min(cap * size, L * weight)``: sources that reach their cap first are those of least size for each
    weight, so running sums in that order find L. The windows hold one row for each source, not documents.
    """
    each = F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("rank") % len(weights) + 1)
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1).withColumn("weight", each)
    bound = ranked.withColumn("most", F.col("source_size") * cap).withColumn("level", F.col("most") / F.col("weight"))
    order = Window.orderBy("level", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the level if this source and those after it are free
    at = bound.withColumn("free", (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # past the first such source in this order the value only falls, so that the largest is the level
    level = F.max(F.when(F.col("free") <= F.col("level"), F.col("free"))).over(everything)
    return at.withColumn("target", F.least(F.col("most"), level * F.col("weight")).cast("double")).select("source", "source_size", "target")


def tilt(stats: Column, target: Column, cap: float) -> Column:
    """lambda with sum(n * min(cap, q * exp(lambda))) = target, by Newton steps on the dual; stats: array of (q, n)."""

    def total(lam: Column, only_free: bool) -> Column:
        def add(acc, x):
            rate = x["q"] * F.exp(lam)
            return acc + F.when(rate < cap, x["n"] * rate).otherwise(F.lit(0.0) if only_free else x["n"] * cap)

        return F.aggregate(stats, F.lit(0.0), add)

    def step(lam, _):
        slope = total(lam, True)
        move = (total(lam, False) - target) / slope
        return F.when(slope > 0, lam - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), move))).otherwise(lam - F.when(total(lam, False) > target, 0.5).otherwise(0.0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), step)


def mix(df: DataFrame, *, cap: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), base: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rates and copies of every document.

    Returns ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``rate``, ``copies`` and ``taken``
    (copies * size), and ``key``, a hash of the text that tells rows of one id apart. Copies are the whole number below
    or above the rate, never over ``cap``.

    Null and empty texts have size 0 and are taken once (0 words). A null source is a source of its own. Null ids are
    allowed. Repeated rows are documents of their own and are
    taken equally often. An empty table gives none. Sources whose size is 0 have the
    target 0. Other columns are not read.
    """
    base = F.lit(1.0) if base is None else base
    sized = df.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
        word_count(text_col).alias("size"),
        held(base).alias("q"),
    )
    # counting words is the costly part: once, not for sums and copies alike
    sized = stored(sized, "sizes")
    sums = sized.groupBy("source", "q").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
    by_source = sums.groupBy("source").agg(
        F.sum("n").alias("source_size"),
        F.sum("rows").alias("source_rows"),
        F.sort_array(F.collect_list(F.struct("q", F.col("n").cast("double").alias("n")))).alias("stats"),
    )
    # one row for each source
    targets = source_targets(by_source.select("source", "source_size"), cap, weights).select(F.col("source").alias("s"), "target")
    dual = by_source.join(targets, by_source.source.eqNullSafe(targets.s)).drop("s")
    dual = dual.withColumn("lam", F.when((F.col("target") > 0) & (F.col("source_size") > 0), tilt(F.col("stats"), F.col("target"), cap)))
    dual = dual.select(F.col("source").alias("s"), "source_size", "target", "lam", F.ceil(F.col("source_rows") / SHARD_ROWS).alias("shards"))
    rated = sized.join(dual, sized.source.eqNullSafe(dual.s)).drop("s")
    rate = F.least(F.lit(float(cap)), F.col("q") * F.exp("lam"))
    rated = rated.withColumn("rate", F.when(F.col("size") > 0, F.coalesce(rate, F.lit(0.0))).otherwise(1.0))
    rated = rated.withColumn("shard", F.pmod(F.xxhash64("doc_id", "key"), "shards")).drop("q", "lam", "shards")
    names = ["doc_id", "source", "key", "size", "source_size", "target", "rate"]
    schema = ", ".join(f"`{n}` {dict(rated.dtypes)[n]}" for n in names) + ", copies long"

    def diffuse(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["size", "key", "doc_id"], ascending=[False, True, True], kind="stable")
        copies, lag = [], 0.0
        rows = zip(shard["size"].tolist(), shard["key"].tolist(), shard["doc_id"].tolist(), shard["rate"].tolist())
        for (size, _, _), same in groupby(rows, key=lambda r: (r[0], r[1], str(r[2]))):
            rates = [r[3] for r in same]
            low = int(rates[0] + 1e-9)
            words = size * len(rates)
            due = lag + (rates[0] - low) * words
            up = rates[0] - low > 1e-9 and 2 * due >= words
            copies += [low + up] * len(rates)
            lag = due - up * words
        return shard[names].assign(copies=copies)

    rounded = rated.groupBy("source", "shard").applyInPandas(diffuse, schema)
    return rounded.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as it is taken, with the columns of ``df``.

    Equal rows are taken equally often.
    """
    taken = mix(df, id_col=id_col, text_col=text_col, source_col=source_col, **kw).where("copies > 0")
    taken = taken.select(F.col("doc_id").alias("__i"), F.col("source").alias("__s"), F.col("key").alias("__k"), F.col("copies").alias("__n")).distinct()
    rows = df.withColumn("__key", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    on = rows["__key"].eqNullSafe(taken["__k"]) & rows[id_col].eqNullSafe(taken["__i"]) & rows[source_col].eqNullSafe(taken["__s"])
    return rows.join(taken, on).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(*df.columns)
