"""Points in order of time, beside those before them, however many points a series has.

A series of many points is cut into chunks that any task can sort. The cuts are points: those whose hash ends in zeros, so that both scans find the same ones without
anything being sampled, and at most 2 ** BITS - 1 of them, those of least hash. Every point is in the chunk behind the last cut that is less than the point; a cut thus ends a chunk, and a
copy of it, an edge, begins the next one, where it only is what the next point has before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

SMALL = 8 << 20  # points from tables of fewer bytes are not cut
UNKNOWN = 1 << 62  # what Spark takes as size of what it cannot know, as of an RDD
SHARE = 4 << 20  # bytes of those tables for a partition, unless there are more of them anyway
APART = 1 << 12  # points from one cut to the next, about
BITS = 12


def by_time(points: DataFrame, *ties: str) -> tuple[DataFrame, WindowSpec, Column]:
    """Points, the window in which each has its neighbours before it, and which rows are points of their own: not edges.

    ties: the values that the caller looks at. They order points whose place is the same."""
    keys = ["ts", "origin", "seq"]
    leaves = points._jdf.queryExecution().optimizedPlan().collectLeaves()  # not the plan's own estimate: for a join that is a product
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    size = sum(x for x in sizes if x < UNKNOWN)
    if size < SMALL and all(x < UNKNOWN for x in sizes):
        return points, Window.partitionBy("series").orderBy(*keys), F.lit(True)
    keys += ties
    most, n = (1 << BITS) - 1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed, point = F.xxhash64("series", *keys), F.struct("series", *keys)
    found = points.where(F.pmod(hashed, F.lit(APART)) == 0).select("series", *keys).distinct().orderBy(hashed, "series", *keys).limit(most)
    cuts = found.agg(F.sort_array(F.collect_list(point))).scalar()
    # one mention of the cuts, as each is a plan of its own
    df = points.withColumn("_point", point).withColumn("_cuts", cuts).withColumn("_at", F.lit(0))
    for k in reversed(range(BITS)):  # a binary search: _at cuts are not greater than the point
        df = df.withColumn("_at", F.col("_at") + F.when(F.get("_cuts", F.col("_at") + ((1 << k) - 1)) <= F.col("_point"), 1 << k).otherwise(0))
    df = df.withColumn("_cut", F.coalesce(F.get("_cuts", F.col("_at") - 1) == F.col("_point"), F.lit(False))).drop("_cuts", "_point")
    # outer: else a filter is inferred, and the whole search written out in it
    df = df.withColumn("_chunk", F.explode_outer(F.when(F.col("_cut"), F.array(F.col("_at") - 1, "_at")).otherwise(F.array("_at"))))
    df = df.withColumn("_edge", F.col("_cut") & (F.col("_chunk") == F.col("_at"))).drop("_at", "_cut")
    # by chunk alone, which keeps all series of a chunk in a task: a series that is a constant is no key of the window
    return df.repartition(max(n, min(most, size // SHARE)), "_chunk"), Window.partitionBy("series", "_chunk").orderBy(*keys), ~F.col("_edge")
