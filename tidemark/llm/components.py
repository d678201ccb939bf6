"""Connected components of links between long ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, saved

PER_FILE = 200_000  # links in a file of a round


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b); a component is named by its smallest node.

    Each round links every node's larger neighbours to its smallest one, then its smaller ones; the number of links
    never grows, and rounds grow with the logarithm of the longest chain. Rounds are written to the shared folder.
    """
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen, files = None, -(-edges.count() // PER_FILE) or 1  # the rounds' tables are no larger
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large.coalesce(files), "large-star")
        small = large.join(_least(large), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(_least(large).select("u", F.col("m").alias("v"))).distinct()
        discard(edges)
        edges = saved(small.coalesce(files), "small-star")
        discard(large)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
