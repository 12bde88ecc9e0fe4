"""Connected components of links, as joins and minima that Spark shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm._shared import stored


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``links`` (a, b: longs): returns ``node``, ``component``.

    Each pass takes the least label of a node's neighbours and then the label of that label, so that passes grow with
    the logarithm of a component's width. Every pass is written to the shared folder. Loops, repeated links and an
    empty table are allowed; links with a null end are ignored.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        least = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("now"))
        up = labels.select(F.col("node").alias("now"), F.col("component").alias("up"))
        after = stored(least.join(up, "now").select("node", "was", F.least("now", "up").alias("component")), "labels")
        labels = after.select("node", "component")
        if after.where("was <> component").isEmpty():
            return labels
