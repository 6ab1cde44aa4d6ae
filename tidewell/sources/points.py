"""The points frame and what fills it.

series, ts (an integer in the database's precision), origin and seq (order among equal ts), tp (integer, float or string) and one filled
column among vi, vd, vs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("series", "ts", "origin", "seq", "tp", "vi", "vd", "vs")
SCHEMA = "series string, ts long, origin string, seq long, tp string, vi long, vd double, vs string"
VALUE = {"integer": "vi", "float": "vd", "string": "vs"}
KIND = {"integer": "long", "float": "double", "string": "string"}
KINDS = frozenset(VALUE)


def place() -> Column:
    """The order of a series' points."""
    return F.struct("ts", "origin", "seq")


def from_frame(df: DataFrame, series: Column, ts: Column, value: Column, tp: str, seq: Column | None = None) -> DataFrame:
    """A typed table as points; only the columns that the expressions use are read."""
    cells = [(value if name == tp else F.lit(None)).cast(KIND[name]).alias(column) for name, column in VALUE.items()]
    return df.select(series.cast("string").alias("series"), ts.cast("long").alias("ts"), F.lit("").alias("origin"), (F.lit(0) if seq is None else seq).cast("long").alias("seq"), F.lit(tp).alias("tp"), *cells)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def micros(ts: Column) -> Column:
    """Unix microseconds of a timestamp without zone, taken as UTC."""
    return F.unix_micros(F.to_timestamp(ts).cast("timestamp"))
