"""The point functions: each maps the points of every series to new points, as DataFrame operations.

A step takes points and the set of types that they may have, and returns both. Order among points is (ts, origin, seq); after a bucket a series has one point at a
time, so origin is empty and seq 0."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.errors import QueryError
from tidewell.operators.buckets import with_label
from tidewell.operators.neighbours import by_time
from tidewell.operators.series_set import TEXT_OPS, anchored
from tidewell.plans.ast import Func, Regex
from tidewell.sources.points import COLUMNS, KIND, VALUE, place

Kinds = frozenset
MEDIANS = ("median", "median_low", "median_high")


def run_chain(points: DataFrame, kinds: Kinds, chain: tuple[Func, ...]) -> tuple[DataFrame, Kinds]:
    for func in chain:
        points, kinds = step(points, kinds, func)
    return points, kinds


def step(points: DataFrame, kinds: Kinds, func: Func) -> tuple[DataFrame, Kinds]:
    name, args = func.name, func.args
    if name == "all":
        return points, kinds
    if name == "filter":
        return filtered(points, kinds, *args)
    if name == "timeval":
        return _shaped(points, "integer", F.col("ts"), keep=True), frozenset({"integer"})
    if name == "interval":
        df, window, own = by_time(points)
        df = df.withColumn("_gap", F.col("ts") - F.lag("ts").over(window)).where(own & F.col("_gap").isNotNull())
        return _shaped(df, "integer", F.col("_gap"), keep=True), frozenset({"integer"})
    if name == "limit":
        return limited(points, kinds, *args)
    if name == "derivative" and len(args) < 2:
        return slopes(points, kinds, args[0] if args else 1)
    if name == "difference" and not args:
        return differences(points, kinds)
    span = args[0] if name == "derivative" else None
    if name != "derivative" and not args:
        return aggregated(points, kinds, name, None)
    g = args[-1]
    if g <= 0:
        raise QueryError("Group by time must be an integer value larger than zero.")
    return aggregated(with_label(points, g, func.offset), kinds, name, F.col("label"), None if span is None else F.lit(span / g))


def _shaped(df: DataFrame, tp: str, value: Column, keep: bool = False) -> DataFrame:
    """df as points of one type; keep: with its origin and seq."""
    cells = [(value if t == tp else F.lit(None)).cast(KIND[t]).alias(c) for t, c in VALUE.items()]
    return df.select("series", "ts", *(["origin", "seq"] if keep else [F.lit("").alias("origin"), F.lit(0).cast("long").alias("seq")]), F.lit(tp).alias("tp"), *cells)


def _no_strings(kinds: Kinds, name: str, kind: str) -> Column | None:
    """Raises when a string point comes; null otherwise. None if none can."""
    if "string" not in kinds:
        return None
    return F.when(F.col("tp") == "string", F.raise_error(F.lit(f"Cannot use {name}() on string type.")).cast(kind))


def _checked(value: Column, kinds: Kinds, name: str, kind: str) -> Column:
    bad = _no_strings(kinds, name, kind)
    return value if bad is None else F.coalesce(bad, value)


def _double(kinds: Kinds, name: str) -> Column:
    cells = [F.col(VALUE[t]).cast("double") for t in ("float", "integer") if t in kinds]
    return _checked(F.coalesce(*cells) if cells else F.lit(None).cast("double"), kinds, name, "double")


def _extreme(name: str) -> Column:
    """The least or greatest float: NaN only if the first point is."""
    own = F.min if name == "min" else F.max
    return F.when(F.isnan(F.min_by("vd", place())), F.lit(math.nan)).otherwise(own(F.when(~F.isnan("vd"), F.col("vd"))))


def _overflow(value: Column, bad: Column, name: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(f"Overflow detected while using {name}().")).cast("long")).otherwise(value)


def measures(name: str, kinds: Kinds, factor: Column | None = None) -> tuple[dict[str, Column], str | None]:
    """The result's value columns as aggregates, and its type, None if that of the input."""
    if name == "count":
        return {"vi": F.count(F.lit(1))}, "integer"
    if name in ("first", "last"):
        pick = F.min_by if name == "first" else F.max_by
        return {VALUE[t]: pick(VALUE[t], place()) for t in kinds}, None
    if name in ("mean", "variance", "pvariance", "stddev"):
        own = {"mean": F.avg, "variance": F.var_samp, "pvariance": F.var_pop, "stddev": F.stddev_samp}[name]
        value = own(_double(kinds, name))
        return {"vd": F.coalesce(value, F.lit(0.0)) if name in ("variance", "stddev") else value}, "float"
    if name == "derivative":
        x = _double(kinds, name)
        rise = F.when(F.count(F.lit(1)) == 1, F.lit(0.0)).otherwise(F.max_by(x, place()) - F.min_by(x, place()))
        return {"vd": rise * factor}, "float"
    vi = _checked(F.col("vi"), kinds, name, "long")
    out = {}
    if "integer" in kinds or kinds == {"string"}:
        if name == "sum":
            total = F.try_sum(vi)
            out["vi"] = _overflow(total, total.isNull() & (F.count("vi") > 0), name)
        elif name == "difference":
            last, first = F.max_by(vi, place()), F.min_by(vi, place())
            rise = F.try_subtract(last, first)
            out["vi"] = _overflow(rise, rise.isNull() & last.isNotNull(), name)
        else:
            out["vi"] = (F.min if name == "min" else F.max)(vi)
    if "float" in kinds:
        vd = _checked(F.col("vd"), kinds, name, "double")
        if name == "sum":
            out["vd"] = F.sum(vd)
        elif name == "difference":
            out["vd"] = F.when(F.count(F.lit(1)) == 1, F.max(F.when(vd.isNotNull(), F.lit(0.0)))).otherwise(F.max_by(vd, place()) - F.min_by(vd, place()))
        else:
            bad = _no_strings(kinds, name, "double")
            out["vd"] = _extreme(name) if bad is None else F.coalesce(F.max(bad), _extreme(name))
    return out, None


def aggregated(points: DataFrame, kinds: Kinds, name: str, label: Column | None, factor: Column | None = None) -> tuple[DataFrame, Kinds]:
    """One point for each series, or for each series and label."""
    if name in MEDIANS:
        return medians(points, kinds, name, label)
    out, tp = measures(name, kinds, factor)
    keys = ["series"] if label is None else ["series", "label"]
    several = tp is None and len(kinds) > 1
    if several:
        keys.append("tp")
    stamps = {"ts": F.min("ts") if name == "first" else F.max("ts")} if label is None else {}
    if label is not None and name in ("first", "last") and "string" in kinds:
        stamps["_own"] = (F.min if name == "first" else F.max)("ts")  # strings keep the time of their point
    df = points.groupBy(*keys).agg(*[v.alias(k) for k, v in {**stamps, **out}.items()])
    if label is not None:
        df = df.withColumn("ts", F.col("label") if "_own" not in stamps else F.when(F.col("vs").isNotNull(), F.col("_own")).otherwise(F.col("label")))
    if several:
        result = F.col("tp")
    else:
        result = F.lit(tp or next(iter(kinds)))
    cells = [(F.col(c) if c in out else F.lit(None)).cast(KIND[t]).alias(c) for t, c in VALUE.items()]
    return df.select("series", "ts", F.lit("").alias("origin"), F.lit(0).cast("long").alias("seq"), result.alias("tp"), *cells), frozenset({tp}) if tp else kinds


def medians(points: DataFrame, kinds: Kinds, name: str, label: Column | None) -> tuple[DataFrame, Kinds]:
    """The middle by rank: sorted and spilled by Spark, so that a group of any size needs no more memory."""
    keys = ["series"] if label is None else ["series", "label"]
    everything = Window.partitionBy(*keys)
    value = [F.col(VALUE[t]) for t in ("integer", "float") if t in kinds]
    bad = _no_strings(kinds, name, "double")
    df = points.withColumn("_n", F.count(F.lit(1)).over(everything)).withColumn("_k", F.row_number().over(everything.orderBy(*(value or ["vs"]))))
    stamp = F.max("ts").over(everything) if label is None else F.col("label")
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    df = df.withColumn("_stamp", stamp)
    if bad is not None:
        df = df.withColumn("vd", F.coalesce(bad, F.col("vd")))
    if name == "median":
        df = df.where((F.col("_k") == low) | (F.col("_k") == high)).groupBy("series", "_stamp").agg(F.avg(_double(kinds - {"string"}, name)).alias("vd"))
        df = df.select("series", F.col("_stamp").alias("ts"), "vd")
        return _shaped(df, "float", F.col("vd")), frozenset({"float"})
    df = df.where(F.col("_k") == (low if name == "median_low" else high))
    return df.select("series", F.col("_stamp").alias("ts"), F.lit("").alias("origin"), F.lit(0).cast("long").alias("seq"), "tp", "vi", "vd", "vs"), kinds


def differences(points: DataFrame, kinds: Kinds) -> tuple[DataFrame, Kinds]:
    df, window, own = by_time(points, *[VALUE[t] for t in ("integer", "float") if t in kinds])
    df = df.withColumn("_k", F.row_number().over(window))
    cells = {}
    if "string" in kinds:
        df = df.withColumn("_bad", _no_strings(kinds, "difference", "long"))
    if "integer" in kinds:
        before = F.lag("vi").over(window)
        rise = F.try_subtract(F.col("vi"), before)
        cells["vi"] = _overflow(rise, rise.isNull() & before.isNotNull() & F.col("vi").isNotNull(), "difference")
    if "float" in kinds:
        cells["vd"] = F.col("vd") - F.lag("vd").over(window)
    if cells:
        df = df.withColumns(cells)
    if "string" in kinds:
        df = df.withColumn("vi", F.coalesce("_bad", "vi")).where(F.col("_bad").isNull())
    return df.where(own & (F.col("_k") > 1)).select(*COLUMNS), kinds


def slopes(points: DataFrame, kinds: Kinds, span: int) -> tuple[DataFrame, Kinds]:
    """Rise by time between neighbours; equal times give infinity or NaN as division of floats does."""
    df, window, own = by_time(points.withColumn("_x", _double(kinds, "derivative")), "_x")
    df = df.withColumn("_rise", F.col("_x") - F.lag("_x").over(window)).withColumn("_run", (F.col("ts") - F.lag("ts").over(window)).cast("double"))
    if "string" in kinds:
        df = df.where(F.col("_x").isNotNull())
    df = df.where(own & F.col("_run").isNotNull())
    flat = F.when((F.col("_rise") > 0) & ~F.isnan("_rise"), F.lit(math.inf)).when(F.col("_rise") < 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))
    return _shaped(df, "float", F.when(F.col("_run") == 0, flat).otherwise(F.try_divide("_rise", "_run")) * F.lit(float(span)), keep=True), frozenset({"float"})


def limited(points: DataFrame, kinds: Kinds, n: int, name: str) -> tuple[DataFrame, Kinds]:
    """At most about n points a series: those with no more stay as they are, others are put in buckets of a width and offset of their own."""
    stats = points.groupBy("series").agg(F.count(F.lit(1)).alias("_len"), F.min("ts").alias("_t0"), F.max("ts").alias("_t1"))
    df = points.join(stats, "series")
    few = df.where(F.col("_len") <= n).select(*COLUMNS)
    many = df.where(F.col("_len") > n).withColumn("_width", F.col("_t1") - F.col("_t0") - F.pmod(F.col("_t1") - F.col("_t0"), F.lit(n)))
    many = many.withColumn("_width", F.floor(F.col("_width").cast("decimal(20,0)") / n).cast("long") + 1)
    many = many.withColumn("_shift", F.pmod(F.col("_t0") - 1, F.col("_width")))
    out, after = aggregated(with_label(many, F.col("_width"), F.col("_shift")), kinds, name, F.col("label"))
    return few.unionByName(out), kinds | after


def filtered(points: DataFrame, kinds: Kinds, op: str, kind: str, value) -> tuple[DataFrame, Kinds]:
    """Points whose value compares with a literal, which is cast to the series' type; NaN equals NaN alone and is in no other order."""
    tests = []
    text = kind in ("string", "regex")
    wrong = "Cannot use a string filter on number type." if text else "Cannot use a number filter on string type."
    for tp in sorted(kinds):
        mine = F.col("tp") == tp
        if (tp == "string") != text:
            tests.append(mine & F.raise_error(F.lit(wrong)).cast("boolean"))
        elif isinstance(value, Regex):
            found = F.col("vs").rlike(anchored(value))
            tests.append(mine & (found if op == "==" else ~found))
        elif text:
            tests.append(mine & TEXT_OPS[op](F.col("vs"), F.lit(value)))
        elif tp == "integer":
            if isinstance(value, float) and not math.isfinite(value):
                tests.append(mine & F.raise_error(F.lit("Cannot use nan or inf as a filter on integer type.")).cast("boolean"))
            else:
                tests.append(mine & TEXT_OPS[op](F.col("vi"), F.lit(int(value)).cast("long")))
        else:
            tests.append(mine & float_test(F.col("vd"), op, float(value)))
    if len(kinds) == 1 and not ((("string" in kinds) != text) or isinstance(value, float) and not math.isfinite(value)):
        return points.where(_bare(kinds, op, value)), kinds
    return points.where(reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])), kinds


def _bare(kinds: Kinds, op: str, value) -> Column:
    """Without the type test, so that it can be pushed to a scan."""
    tp = next(iter(kinds))
    if isinstance(value, Regex):
        found = F.col("vs").rlike(anchored(value))
        return found if op == "==" else ~found
    if tp == "string":
        return TEXT_OPS[op](F.col("vs"), F.lit(value))
    if tp == "integer":
        return TEXT_OPS[op](F.col("vi"), F.lit(int(value)).cast("long"))
    return float_test(F.col("vd"), op, float(value))


def float_test(v: Column, op: str, x: float) -> Column:
    if math.isnan(x):
        return {"==": F.isnan(v), "!=": ~F.isnan(v), ">=": F.isnan(v), "<=": F.isnan(v)}.get(op, F.lit(False))
    found = TEXT_OPS[op](v, F.lit(x))
    return found & ~F.isnan(v) if op in (">", ">=") else found
