"""Connected components of a link table, without collecting it.

Alternates large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014). Each step takes a minimum per node,
which combines before the shuffle, and joins it back to the links, where Spark
may split a node with very many links. Every round is written to shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import remove, written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b), a > b. One star step, again as (a, b), a > b."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        up = both.filter("b > a").join(least, "a")
        return up.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(least, "a")
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that is linked to a smaller one; root is the smallest node reachable.

    ``links``: columns a and b, any order, repeats and self links allowed.
    """
    spark = links.sparkSession
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now, path = written(now, "links")
    state = _state(now)
    while True:
        after, after_path = written(_stars(_stars(now, True), False), "links")
        # the round before is read no more: if an executor is lost, this round's files are there
        remove(spark, path)
        now, path, before = after, after_path, state
        state = _state(now)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
