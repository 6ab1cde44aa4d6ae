"""From a select statement to a plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.chain import Kinds, measures, run_chain
from tidewell.operators.buckets import with_label
from tidewell.plans import ast
from tidewell.plans.parser import GROUPED
from tidewell.sources.points import COLUMNS, KIND, VALUE


@dataclass
class Result:
    points: DataFrame
    kinds: Kinds

    def frame(self) -> DataFrame:
        """series, ts and value; with several types that may come: series, ts, type and a column for each."""
        if len(self.kinds) == 1:
            (tp,) = self.kinds
            return self.points.select("series", "ts", F.col(VALUE[tp]).alias("value"))
        return self.points.select("series", "ts", F.col("tp").alias("type"), *[F.col(VALUE[t]).alias(f"value_{t}") for t in sorted(self.kinds)])


def in_span(points: DataFrame, span: ast.Span | None) -> DataFrame:
    """after includes its time, before does not."""
    if span is None:
        return points
    if span.kind == "after":
        return points.where(F.col("ts") >= span.first)
    if span.kind == "before":
        return points.where(F.col("ts") < span.first)
    if span.kind == "between":
        return points.where((F.col("ts") >= span.first) & (F.col("ts") < span.second))
    order = [F.col(c).asc() if span.kind == "head" else F.col(c).desc() for c in ("ts", "origin", "seq")]
    rank = F.row_number().over(Window.partitionBy("series").orderBy(*order))
    return points.withColumn("_k", rank).where(F.col("_k") <= span.first).drop("_k")


def _renamed(points: DataFrame, item: ast.Item) -> DataFrame:
    if not item.prefix and not item.suffix:
        return points
    return points.withColumn("series", F.concat(F.lit(item.prefix), "series", F.lit(item.suffix)))


def _fusable(item: ast.Item) -> bool:
    """Whether the item is one aggregate that shares its buckets with others."""
    f = item.chain[0]
    return len(item.chain) == 1 and f.name in GROUPED and not f.name.startswith("median") and len(f.args) == 1


def _fused(points: DataFrame, kinds: Kinds, items: list[ast.Item]) -> tuple[DataFrame, Kinds]:
    """Items with the same buckets of one type from one aggregation."""
    f = items[0].chain[0]
    df = with_label(points, f.args[0], f.offset)
    made, after, rows = [], set(), []
    (own,) = kinds
    for k, item in enumerate(items):
        out, tp = measures(item.chain[0].name, kinds)
        tp = tp or own
        after.add(tp)
        made += [v.alias(f"_{k}_{c}") for c, v in out.items()]
        cells = [(F.col(f"_{k}_{c}") if c in out else F.lit(None)).cast(KIND[t]).alias(c) for t, c in VALUE.items()]
        rows.append(F.struct(F.concat(F.lit(item.prefix), "series", F.lit(item.suffix)).alias("series"), F.col("label").alias("ts"), F.lit("").alias("origin"), F.lit(0).cast("long").alias("seq"), F.lit(tp).alias("tp"), *cells))
    return df.groupBy("series", "label").agg(*made).select(F.inline(F.array(*rows))), frozenset(after)


def select(points: DataFrame, kinds: Kinds, stmt: ast.Select) -> Result:
    """points: those of the matched series, in the statement's time range."""
    groups: dict = {}
    for item in stmt.items:
        f = item.chain[0]
        key = (f.args, f.offset) if _fusable(item) and not stmt.merge and len(kinds) == 1 and kinds != {"string"} else id(item)
        groups.setdefault(key, []).append(item)
    parts = []
    for items in groups.values():
        if len(items) > 1:
            parts.append(_fused(points, kinds, items))
        else:
            df, after = run_chain(points, kinds, items[0].chain)
            parts.append((_renamed(df, items[0]), after))
    if stmt.merge:
        return _merged(parts, groups, stmt)
    return Result(reduce(DataFrame.unionByName, [p for p, _ in parts]).select(*COLUMNS), frozenset().union(*[k for _, k in parts]))


def _merged(parts: list, groups: dict, stmt: ast.Select) -> Result:
    """The points of every item's series as one series; ties in the order of the names they come from."""
    out = []
    for (df, kinds), (item,) in zip(parts, groups.values(), strict=True):
        name = F.lit(item.prefix + stmt.merge.name + item.suffix)
        df, kinds = promoted(df.withColumn("origin", F.concat("series", F.lit("\x00"), "origin")).withColumn("series", name), kinds)
        out.append(run_chain(df, kinds, stmt.merge.using))
    return Result(reduce(DataFrame.unionByName, [p for p, _ in out]).select(*COLUMNS), frozenset().union(*[k for _, k in out]))


def promoted(points: DataFrame, kinds: Kinds) -> tuple[DataFrame, Kinds]:
    """In a merged series that has both, integers become floats; strings and numbers do not merge."""
    if len(kinds) == 1:
        return points, kinds
    has = lambda tp: F.max((F.col("tp") == tp).cast("int")).alias(f"_{tp}")
    flags = points.groupBy("series").agg(has("float"), has("integer"), has("string"))  # a row for each select item
    df = points.join(F.broadcast(flags), "series")
    bad = (F.col("_string") == 1) & ((F.col("_float") == 1) | (F.col("_integer") == 1))
    float_too = F.when(bad, F.raise_error(F.lit("Cannot merge string and number series.")).cast("boolean")).otherwise((F.col("_float") == 1) & (F.col("tp") == "integer"))
    df = df.withColumn("_up", float_too)
    df = df.withColumns({"vd": F.when(F.col("_up"), F.col("vi").cast("double")).otherwise(F.col("vd")), "tp": F.when(F.col("_up"), F.lit("float")).otherwise(F.col("tp")), "vi": F.when(~F.col("_up"), F.col("vi"))})
    return df.select(*COLUMNS), kinds
