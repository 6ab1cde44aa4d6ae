"""Frames and files as staged points: the same checks as for inserted objects, made where the rows are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.errors import InsertError

WHOLE = ("tinyint", "smallint", "int", "bigint")
REAL = ("float", "double")


def staged_frame(df: DataFrame, most_ts: int, first_seq: int = 0) -> DataFrame:
    """Staged points of a frame with series, ts, value and perhaps seq (else all are 0 and equal times stay in no certain order).

    A row with a bad name, time or value makes the insert fail when it runs."""
    types = dict(df.dtypes)
    if not {"series", "ts", "value"} <= set(types) or types["ts"] not in WHOLE:
        raise InsertError("Expecting an integer value as time-stamp.")
    kind = "integer" if types["value"] in WHOLE else "float" if types["value"] in REAL else "string" if types["value"] == "string" else None
    if kind is None:
        raise InsertError("Unsupported value received. (only integer, float and string values are supported).")

    def bad(test: Column, message: str) -> Column:
        return F.when(test, F.raise_error(F.lit(message)).cast("string"))

    name = F.coalesce(
        bad(F.col("series").isNull() | (F.col("series") == ""), "Expecting a series name (string value) with an array of points where each point should be an integer time-stamp with a value."),
        bad(F.col("ts").isNull() | (F.col("ts") < 0) | (F.col("ts") > most_ts), "A time-stamp is out-of-range for this database."),
        bad(F.col("value").isNull(), "Unsupported value received. (only integer, float and string values are supported)."), "series",
    )
    seq = F.col("seq").cast("long") if "seq" in types else F.lit(first_seq).cast("long")
    cells = [(F.col("value") if k == kind else F.lit(None)).cast(t).alias(c) for k, t, c in (("integer", "long", "i"), ("float", "double", "d"), ("string", "string", "s"))]
    return df.select(name.alias("series"), F.col("ts").cast("long").alias("ts"), seq.alias("seq"), F.lit(kind).alias("kind"), *cells)


def csv_points(spark: SparkSession, path: str, value: str = "double", header: bool = True) -> DataFrame:
    """A frame for Engine.insert_frame of CSV files with series, ts and value."""
    return spark.read.schema(f"series string, ts long, value {value}").csv(path, header=header, mode="FAILFAST")


def json_points(spark: SparkSession, path: str, value: str = "double") -> DataFrame:
    """A frame for Engine.insert_frame of JSON lines of the array form: name, and points as pairs of time and value."""
    lines = spark.read.schema("name string, points array<array<string>>").json(path, mode="FAILFAST")
    pairs = lines.select(F.col("name").alias("series"), F.posexplode("points").alias("seq", "p"))
    return pairs.select("series", F.get("p", F.lit(0)).cast("long").alias("ts"), F.get("p", F.lit(1)).cast(value).alias("value"), F.col("seq").cast("long").alias("seq"))
