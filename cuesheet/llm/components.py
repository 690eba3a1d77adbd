"""Connected components of a large graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.session import materialise


def _stars(pairs: DataFrame, include_self: bool) -> DataFrame:
    """For every node u of ``(u, v)`` pairs: link each v, and with ``include_self`` u, to the least of u and its v."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = pairs.join(least.hint("merge"), "u")
    links = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if include_self:
        links = links.union(least.where(F.col("u") != F.col("m")).select("u", F.col("m").alias("v")))
    return links.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the ``(u, v)`` edges; the component is its least node.

    Each step is a grouped minimum, summed per task first, and a join whose rows stream through a sort, so a hub of any
    degree is never gathered; its rows do meet in one task. The number of rounds grows with the logarithm of the graph. No edges give no rows.
    """
    now = materialise(edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least.hint("merge"), "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        now = materialise(_stars(large, include_self=True).select("u", "v"))
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
