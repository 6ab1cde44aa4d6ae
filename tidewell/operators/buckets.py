"""Time buckets: closed on the right and labelled by their right edge.

With an offset the label depends on the points before: a group labelled k * g + offset also takes the points of the first offset
units after k * g, if it is open there. It is open if the bucket before has a point behind its own first offset units, or has points only
within them that open a new group. Along buckets that have only such points the state alternates, so it is found by window functions over one row a
bucket, however many points there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_label(points: DataFrame, g: Column | int, offset: Column | int = 0) -> DataFrame:
    """points with label."""
    g = F.lit(g).cast("long") if isinstance(g, int) else g
    up = F.col("ts") + F.pmod(-F.col("ts"), g)
    if isinstance(offset, int) and offset == 0:
        return points.withColumn("label", up)
    o = F.lit(offset).cast("long") if isinstance(offset, int) else offset
    # the bucket begins behind _low; _head: within its first units
    df = points.withColumn("_g", g).withColumn("_o", o).withColumn("_low", up - g)
    df = df.withColumn("_head", F.col("ts") - F.col("_low") <= F.col("_o"))
    per = df.groupBy("series", "_low").agg(F.max("_g").alias("_g"), F.max((~F.col("_head")).cast("int")).alias("tail"))
    by_time = Window.partitionBy("series").orderBy("_low")
    per = per.withColumn("n", F.row_number().over(by_time)).withColumn("next_to", F.coalesce(F.lag("_low").over(by_time) == F.col("_low") - F.col("_g"), F.lit(False)))
    per = per.withColumn("before", F.coalesce(F.lag("tail").over(by_time), F.lit(0)))
    # known: whether the group is open on entry without looking further back
    known = F.when(~F.col("next_to"), F.lit(0)).when(F.col("before") == 1, F.lit(1))
    per = per.withColumn("known", known)
    last = F.last(F.when(F.col("known").isNotNull(), F.struct("known", "n")), ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumn("from", last).withColumn("open", F.pmod(F.col("from.known") + F.col("n") - F.col("from.n"), F.lit(2)) == 1)
    df = df.join(per.select("series", "_low", "open"), ["series", "_low"])
    found = F.when(F.col("_head") & F.col("open"), F.col("_low") + F.col("_o")).otherwise(F.col("_low") + F.col("_g") + F.col("_o"))
    return df.withColumn("label", found).drop("_g", "_o", "_low", "_head", "open")
