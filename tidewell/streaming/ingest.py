"""Structured Streaming: points that arrive as a stream go to the store, and to second sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.sources.store import Store


def into_store(stream: DataFrame, store: Store, checkpoint: str, tees: list[Callable[[DataFrame], None]] | None = None, **trigger) -> StreamingQuery:
    """stream (points) appended to store, batch by batch; late points are welcome, as reading sorts by time anyway."""

    def keep(batch: DataFrame, _: int) -> None:
        store.append(batch)
        for tee in tees or []:
            tee(batch)

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def bucket_stream(stream: DataFrame, g: int, value: str = "vd") -> DataFrame:
    """Running count, sum, least and greatest for each series and bucket (closed on the right), for an update or complete sink."""
    label = F.col("ts") + F.pmod(-F.col("ts"), F.lit(g))
    return stream.groupBy("series", label.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
