"""Connected components of a graph held as a DataFrame, by alternating large and small stars.

Each round hangs every neighbour on the smallest node it sees, first the larger neighbours, then the
smaller ones, until every component is one star.  Rounds are written to the shared folder, so that
lineage stays short and lost executors cost one round.  No node list ever comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, stored

#: Links of one file of a round; small rounds write few files.
FILE_EDGES = 500_000


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(u, v) links of comparable ids to (node, root): every node with a link, and the smallest of its component."""
    spark = links.sparkSession
    path = scratch(spark, "stars")
    edges = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "stars", path)
    mark, files = None, 0
    while True:
        after = scratch(spark, "stars")
        changed = small_star(large_star(edges).filter("u != v").distinct()).filter("u != v").distinct()
        changed = stored(changed.coalesce(files) if files else changed, "stars", after)
        now = changed.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        discard(spark, path)
        edges, path = changed, after
        if now == mark:
            break
        mark, files = now, max(2 * spark.sparkContext.defaultParallelism, now[0] // FILE_EDGES)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
