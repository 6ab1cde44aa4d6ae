"""Connected components of a graph given as edges, by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and component (the smallest node reachable) of every node on an edge between two different nodes.

    edges: a and b, longs, in any order and number; rows with a null are no edges. Each round is written to the shared folder, so that
    its lineage is short and survives lost executors. A hub is a row of minima after partial aggregation, and the joins that go
    back to its edges are ones that Spark can split."""
    now = _distinct(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    now = written(now, name)
    mark = _mark(now)
    while mark[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _distinct(both.join(least, "u").where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(_distinct(small.union(least.select("u", F.col("m").alias("v")))), name)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u", "v").agg(F.lit(1).alias("_")).select("u", "v")


def _mark(pairs: DataFrame) -> tuple:
    """Differs, but for a chance of about 2^-60, if the pairs do."""
    h = F.xxhash64("u", "v")
    return tuple(pairs.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 24))).first())
