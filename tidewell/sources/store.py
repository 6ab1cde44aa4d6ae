"""Points as Parquet, a folder for each time slice, so that a time range reads only its slices; beside it the types of the series."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans.ast import Span
from tidewell.sources.ingest import types_of
from tidewell.sources.points import COLUMNS, SCHEMA, empty

SLICE = "shard_start"
TYPES = "series string, tp string"


@lru_cache(maxsize=1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="tidewell-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, in spark.checkpoint.dir; in a temporary one only where all run in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share.")
    return f"{(shared or _own_dir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Store:
    def __init__(self, spark: SparkSession, path: str, width: int) -> None:
        self.spark, self.path, self.width = spark, path.rstrip("/"), width
        self._types = f"{self.path}-types"

    def append(self, points: DataFrame) -> None:
        """Each slice is sorted, so that the statistics of its row groups tell series and times apart."""
        rows = points.select(*COLUMNS).withColumn(SLICE, F.col("ts") - F.pmod(F.col("ts"), F.lit(self.width)))
        spread = F.pmod(F.xxhash64("series"), F.lit(16))
        rows.repartition(SLICE, spread).sortWithinPartitions(SLICE, "series", "ts", "seq").write.mode("append").partitionBy(SLICE).parquet(self.path)
        fresh = types_of(points)
        if self._there(self._types):
            fresh = fresh.join(self.types(), "series", "left_anti")
        else:
            fresh = types_of(self.read())  # also of points that were there before
        fresh.coalesce(1).write.mode("append").parquet(self._types)

    def types(self) -> DataFrame:
        """series and tp, one row each, without reading points."""
        if not self._there(self._types):
            return types_of(self.read())
        return types_of(self.spark.read.schema(TYPES).parquet(self._types))

    def _file_system(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _there(self, path: str) -> bool:
        system, at = self._file_system(path)
        return system.exists(at)

    def _delete(self, path: str) -> None:
        system, at = self._file_system(path)
        system.delete(at, True)

    def exists(self) -> bool:
        return self._there(self.path)

    def drop(self) -> None:
        self._delete(self.path)
        self._delete(self._types)

    def read(self, span: Span | None = None) -> DataFrame:
        if not self.exists():
            return empty(self.spark)
        df = self.spark.read.schema(f"{SCHEMA}, {SLICE} long").parquet(self.path)
        if span is not None and span.kind in ("after", "between"):
            df = df.where(F.col(SLICE) >= span.first - span.first % self.width)
        if span is not None and span.kind in ("before", "between"):
            df = df.where(F.col(SLICE) < (span.first if span.kind == "before" else span.second))
        return df.select(*COLUMNS)

    def remove(self, gone: Callable[[DataFrame], DataFrame], kept: Callable[[DataFrame], DataFrame]) -> None:
        """Without some points; gone and kept give those of a frame of points that go and stay. Only slices that hold some of them are written anew, and slices that hold nothing else are deleted; the rest stays as it is.

        What stays of a slice is written beside the store before the slice is deleted. Slices are as many as folders."""
        at = F.col("ts") - F.pmod(F.col("ts"), F.lit(self.width))
        slices = [r[0] for r in gone(self.read()).select(at.alias("s")).distinct().collect()]
        if not slices:
            return
        touched = self.spark.read.schema(f"{SCHEMA}, {SLICE} long").parquet(self.path).where(F.col(SLICE).isin(slices)).select(*COLUMNS)
        part = Store(self.spark, f"{self.path}-rest-{uuid.uuid4().hex}", self.width)
        part.append(kept(touched))
        for s in slices:
            self._delete(f"{self.path}/{SLICE}={s}")
        self.append(part.read())
        # a series without points has no type any more
        left = self.types().join(self.read().select("series").distinct(), "series", "left_semi")
        left.coalesce(1).write.parquet(f"{part.path}-left")
        self._delete(self._types)
        self.spark.read.schema(TYPES).parquet(f"{part.path}-left").coalesce(1).write.parquet(self._types)
        self._delete(f"{part.path}-left")
        part.drop()

    def compact(self, path: str) -> Store:
        """The same points in fewer, sorted files elsewhere."""
        out = Store(self.spark, path, self.width)
        out.append(self.read())
        return out

    def expire(self, path: str, oldest: int) -> Store:
        """The slices that end after oldest, elsewhere."""
        out = Store(self.spark, path, self.width)
        out.append(self.read().where(F.col("ts") - F.pmod(F.col("ts"), F.lit(self.width)) + self.width > oldest))
        return out
