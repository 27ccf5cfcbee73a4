"""Connected components by smallest label, spread along links and shortened by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, durable


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of links (columns a, b).

    Each turn takes the smallest label among neighbours, then the label of that label, so
    the turns grow with the logarithm of a component's diameter.  Labels are written each
    turn; sums and minima are combined before they move, and joins on a node with
    very many links stand alone in their stage, so they can be split.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    both = durable(spark, both.filter("u <> v").distinct(), "links")
    labels = durable(spark, both.groupBy("u").agg(F.least("u", F.min("v")).alias("l")), "labels")
    while True:
        now = labels.select("u", "l")
        near = durable(spark, both.join(now.withColumnRenamed("u", "v"), "v").select("u", "l"), "near")
        new = near.union(now).groupBy("u").agg(F.min("l").alias("m"))
        new = durable(spark, new.join(now, "u"), "step")
        jump = new.select(F.col("u").alias("m"), F.col("m").alias("j"))
        jumped = durable(spark, new.join(jump, "m", "left").select("u", F.least("m", F.coalesce("j", "m")).alias("l"), F.col("l").alias("old")), "labels")
        discard(near, new, labels)
        labels = jumped
        if not jumped.filter("l <> old").take(1):
            discard(both)
            return labels.select(F.col("u").alias("node"), F.col("l").alias("label"))
