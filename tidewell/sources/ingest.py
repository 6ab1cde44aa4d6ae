"""Insert: from a map or an array of series to validated, coerced points."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.errors import InsertError
from tidewell.sources.points import COLUMNS, VALUE

STAGED = "series string, ts long, seq long, kind string, i long, d double, s string"
LONG = (-(1 << 63), (1 << 63) - 1)


def _pairs(data: Any) -> Iterator[tuple[str, Any]]:
    if isinstance(data, dict):
        for name, points in data.items():
            if not isinstance(name, str) or not isinstance(points, (list, tuple)):
                raise InsertError("Expecting a series name (string value) with an array of points where each point should be an integer time-stamp with a value.")
            yield name, points
    elif isinstance(data, (list, tuple)):
        for entry in data:
            if not isinstance(entry, dict) or set(entry) != {"name", "points"} or not isinstance(entry["name"], str):
                raise InsertError("Expecting a map with name and points.")
            yield entry["name"], entry["points"]
    else:
        raise InsertError("Expecting an array or map containing series and points.")


def rows(data: Any, most_ts: int = LONG[1], first_seq: int = 0) -> Iterator[tuple]:
    """Checked rows of STAGED."""
    seq = first_seq
    for name, points in _pairs(data):
        if not name:
            raise InsertError("Expecting a series name (string value) with an array of points where each point should be an integer time-stamp with a value.")
        if not isinstance(points, (list, tuple)):
            raise InsertError("Expecting an array with points.")
        if not points:
            raise InsertError("Expecting a series to have at least one point.")
        for point in points:
            if not isinstance(point, (list, tuple)) or len(point) != 2:
                raise InsertError("Expecting an array with points.")
            ts, value = point
            if isinstance(ts, bool) or not isinstance(ts, int):
                raise InsertError("Expecting an integer value as time-stamp.")
            if not 0 <= ts <= most_ts:
                raise InsertError("A time-stamp is out-of-range for this database.")
            if isinstance(value, bool) or not isinstance(value, (int, float, str)) or isinstance(value, int) and not LONG[0] <= value <= LONG[1]:
                raise InsertError("Unsupported value received. (only integer, float and string values are supported).")
            if isinstance(value, int):
                yield name, ts, seq, "integer", value, None, None
            elif isinstance(value, float):
                yield name, ts, seq, "float", None, value, None
            else:
                yield name, ts, seq, "string", None, None, value
            seq += 1


def whole_prefix(s: Column) -> Column:
    """The integer that a text begins with, 0 if none, at most and at least what 64 bits hold."""
    digits = F.regexp_extract(s, r"^\s*([+-]?\d+)", 1)
    short = F.regexp_replace(digits, r"^([+-]?)0*(?=\d)", "$1")
    low = F.lit(LONG[0]).cast("decimal(38,0)")
    high = F.lit(LONG[1]).cast("decimal(38,0)")
    far = F.when(short.startswith("-"), F.lit(LONG[0])).otherwise(F.lit(LONG[1]))
    value = short.try_cast("decimal(38,0)")
    return F.when(digits == "", F.lit(0)).when(F.length(short) > 36, far).otherwise(F.least(F.greatest(value, low), high).cast("long"))


def float_prefix(s: Column) -> Column:
    """The number that a text begins with, 0.0 if none."""
    found = F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))", 1)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def coerced(stage: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Points of a staged frame. The type of a series is that in known (series, tp), else that of its first point by seq."""
    first = stage.groupBy("series").agg(F.min_by("kind", "seq").alias("tp"))
    if known is not None:
        known = known.select("series", F.col("tp").alias("old"))
        first = first.join(known, "series", "left").select("series", F.coalesce("old", "tp").alias("tp"))
    df = stage.join(first, "series")
    tp, kind = F.col("tp"), F.col("kind")
    vi = F.when(kind == "integer", F.col("i")).when(kind == "float", F.col("d").cast("long")).otherwise(whole_prefix(F.col("s")))
    vd = F.when(kind == "float", F.col("d")).when(kind == "integer", F.col("i").cast("double")).otherwise(float_prefix(F.col("s")))
    vs = F.when(kind == "string", F.col("s")).when(kind == "integer", F.col("i").cast("string")).otherwise(F.format_string("%.6f", "d"))
    df = df.withColumns({"origin": F.lit(""), "vi": F.when(tp == "integer", vi), "vd": F.when(tp == "float", vd), "vs": F.when(tp == "string", vs)})
    return df.select(*COLUMNS)


def types_of(points: DataFrame) -> DataFrame:
    return points.groupBy("series").agg(F.min("tp").alias("tp"))


def by_type(values: Iterable[str] = VALUE) -> dict[str, str]:
    return {name: VALUE[name] for name in values}
