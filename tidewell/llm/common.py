"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words; everything else belongs to a word.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = rf"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="tidewell-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset and all run in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share.")
    return (found or _own_dir()).rstrip("/")


#: What bounds a batch that goes to a Python worker (64 MB as Spark has it), and the bound where batches are looked at row by row.
BATCH_BYTES, SMALL_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


def written(df: DataFrame, name: str, small_batches: bool = False) -> DataFrame:
    """df as a table in the shared folder: what it took is not computed again, and no executor's loss undoes it.

    small_batches: workers get SMALL_BATCH at once, unless the session says otherwise; executor and worker each hold a batch or two for every task, beside the heap."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    small_batches = small_batches and spark.conf.get(BATCH_BYTES, None) is None
    if small_batches:
        spark.conf.set(BATCH_BYTES, SMALL_BATCH)
    try:
        df.write.parquet(path)
    finally:
        if small_batches:
            spark.conf.unset(BATCH_BYTES)
    return spark.read.schema(df.schema).parquet(path)


#: Functions with a cache that stays in a Python worker from task to task.
_STAYING: list = []


def staying(cached: Callable) -> Callable:
    """cached, a function with an lru_cache, registered as one whose results go when the worker turns to another operator."""
    _STAYING.append(cached)
    return cached


def lean(body: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], own: Callable | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """body, for mapInArrow, in a worker that holds no other operator's caches; own: the one of staying() that body uses.

    Spark hands workers on to later tasks and never takes memory from them, and what they hold counts to the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = [x for x in _STAYING if x is not own and x.cache_info().currsize]
        for x in others:
            x.cache_clear()
        if others:
            _give_back()
        yield from body(batches)
        _give_back()

    return run


def _give_back() -> None:
    """Memory that is free inside this process goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def word_count(text: Column) -> Column:
    """How many words a text has, as a long; 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.regexp_count(bare, F.lit(f"[{SPACE}]+")) + 1).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, UPPER, LOWER)


#: Bits of a filter for ids, in BITMAPS rows of 4 KB each.
BITMAPS, BITS = 1024, 32768


def perhaps_in(df: DataFrame, column: str, ids: DataFrame, flag: str = "_maybe") -> DataFrame:
    """df with a flag: false only where the column's value is not among ids (a frame of one column of the same type).

    With so many ids that most bits are set the flag is true for nearly all rows and saves nothing; results stay the same.

    The ids' hashes set bits in BITMAPS broadcast rows, 4 MB for any number of ids; the flag keeps rows that cannot
    meet out of a shuffle and is never the answer itself."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAPS * BITS)) + 1
    bits = ids.select(slot(F.col(ids.columns[0])).alias("_h"))
    bits = bits.groupBy(F.bitmap_bucket_number("_h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))
    df = df.withColumn("_slot", slot(F.col(f"`{column}`"))).withColumn("_bucket", F.bitmap_bucket_number("_slot"))
    place = F.bitmap_bit_position("_slot").cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = F.when(F.col("_bits").isNull(), F.lit(False)).otherwise(F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1)
    return df.join(F.broadcast(bits), "_bucket", "left").withColumn(flag, found).drop("_slot", "_bucket", "_bits")
