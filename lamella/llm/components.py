"""Connected components of a graph of links, as a table of ``(node, component)``.

Large-star and small-star steps in turn: each joins the neighbours of every node to the smallest one. A step is a
grouped minimum, partially aggregated, and a join with one row a node, so a node with very many links is one row by the
time it is shuffled, and the join may split it. The links of a step are written to the shared folder, which cuts the
lineage. Only whether the links changed comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import stored

#: Links that a file of a step has, about, and files that it has at most where links are few.
LINKS, FILES = 100_000, 8


def _stars(links: DataFrame, files: int) -> DataFrame:
    """Both steps once, in tables of as many files; links are ``(a, b)`` with a > b."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # Stored, so that both sides of the join are dealt out anew and Spark may split a hot node's side.
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", files)
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    large = stored(large, "stars", files)
    root = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least", files)
    small = large.join(root, "a")
    return small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").union(root.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node that is reachable) for each node of ``links``, columns ``a`` and ``b``."""
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now = stored(now, "links")
    state = None
    while True:
        found = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if found == state or not found["n"]:
            break
        state = found
        files = max(FILES, found["n"] // LINKS)
        now = stored(_stars(now, files), "links", files)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
