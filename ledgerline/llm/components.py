"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import write_down


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node of ``links``; a component is named by its least node.

    Each round hangs every node's greater neighbours, and then the node itself, on the least node
    around (alternating stars), so the number of rounds grows with the logarithm of the longest
    path. Stars are found by aggregates and joins; no neighbourhood is gathered in one task, and
    each round is written down, so a lost executor costs that round only. Null ends and loops are
    dropped; an empty table gives an empty result.
    """
    pairs = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")) \
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    pairs = write_down(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("low")).select("v", F.least("v", "low").alias("low"))
        large = both.join(least, "v").where(F.col("m") > F.col("v")).select(F.col("m").alias("v"), F.col("low").alias("m"))
        large = large.where("v != m").distinct()
        lower = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(lower, "v")
        small = small.select(F.col("m").alias("v"), F.col("low").alias("m")).where("v != m") \
            .unionByName(lower.select("v", F.col("low").alias("m"))).distinct()
        following = write_down(small)
        marks = [t.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(20,0)"))).first() for t in (pairs, following)]
        pairs = following
        if marks[0] == marks[1]:
            break
    return pairs.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(
        pairs.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
