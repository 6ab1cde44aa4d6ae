"""Functions of a point and the one before it, on series that no one task should sort."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewell.engine import Engine
from tidewell.sources.points import from_frame

ASKED = ("select difference() from *", "select derivative(7) from *", "select interval() from *", "select difference() => difference() from *", "select difference() => filter(> 0) => interval() from *")


@pytest.mark.parametrize("text", ASKED[:3])
def test_one_long_series_is_dealt_over_tasks(spark, text):
    n = 1_200_000
    made = spark.range(n).select((F.col("id") * 7919 % n).alias("k"))  # many points share a time
    points = from_frame(made, F.lit("one"), F.floor(F.col("k") / 1000), F.col("k") % 31, "integer", F.col("k"))
    found = Engine(spark, points, kinds={"integer"}, time_precision="s").query(text)
    shares = [r[1] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == n - 1 and max(shares) < n // 2


@pytest.mark.parametrize("text, apart, bits", list(zip(ASKED, (3, 1, 3, 3, 1), (6, 2, 2, 6, 4), strict=True)))
def test_cuts_change_no_result(spark, monkeypatch, text, apart, bits):
    from tidewell.operators import neighbours

    rng = random.Random(5)
    rows = [(f"s{rng.choice((0, 0, 0, 1, 2))}", rng.randrange(40), rng.randrange(9), rng.choice((-0.0, 0.0, 1.5, -2.5, math.nan, math.inf, None))) for _ in range(200)]
    places = {r[:3]: r for r in rows}
    rows = [*places.values(), ("alone", 3, 0, 1.0)]
    if "=>" not in text:  # else points of one place differ, whose order is not certain
        rows += [*(r for k, r in enumerate(places.values()) if k % 3 == 0), *[("same", 1, 0, 2.0)] * 5]
    df = spark.createDataFrame(rows, "series string, ts long, seq long, x double")
    floats = from_frame(df, F.col("series"), F.col("ts"), F.col("x"), "float", F.col("seq"))
    whole = from_frame(df, F.concat(F.lit("i-"), "series"), F.col("ts"), F.when(F.abs("x") < 9, F.col("x") * 2).otherwise(F.lit(5.0)), "integer", F.col("seq"))

    def found():
        made = Engine(spark, floats.unionByName(whole), kinds={"float", "integer"}, time_precision="s").query(text)
        return sorted(map(str, made.collect()))

    monkeypatch.setattr(neighbours, "SMALL", 1 << 99)
    plain = found()
    monkeypatch.setattr(neighbours, "SMALL", 0)
    monkeypatch.setattr(neighbours, "APART", apart)
    monkeypatch.setattr(neighbours, "BITS", bits)
    assert found() == plain
    assert len(plain) > 50
