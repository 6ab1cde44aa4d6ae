"""The plans are the ones wanted: shuffles, pushed filters, columns read, and no Python."""

import pytest
from pyspark.sql import functions as F

from tidewell.engine import Engine
from tidewell.queries import engine
from tidewell.sources.store import Store

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "text, exchanges",
    [
        ("select mean(1h) from *", 1), ("select min(1h) prefix 'a', max(1h) prefix 'b', sum(1h) prefix 'c' from *", 1), ("select difference() => filter(> 0) => timeval() from *", 1), ("select interval() from /v.*/", 1),
        ("select * from 'view', 'click' after '2024-01-10'", 0), ("select mean(1h) => difference() from *", 2), ("select count() from * merge as 'm' using sum(1)", 2), ("select median(1h) from *", 1), ("select sum() from * tail 5", 1),
    ],
)
def test_shuffles(spark, text, exchanges):
    found = plan(engine(spark, SF, "events").query(text))
    assert found.count("Exchange ") - found.count("BroadcastExchange ") == exchanges
    assert "Python" not in found and "Pandas" not in found and "Arrow" not in found and "CartesianProduct" not in found


def test_columns_read(spark):
    found = plan(engine(spark, SF, "events").query("select sum(1h) from *"))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in found
    found = plan(engine(spark, SF, "events").query("select count() from 'view'"))
    assert "EqualTo(event_type,view)" in found


def test_store_filters(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/p", 100)
    own = Engine(spark, store=store, kinds={"integer"}, time_precision="s")
    own.insert({"a": [[t, t] for t in range(500)], "b": [[3, 4]]})
    found = plan(own.query('select sum(10) from "a", "c" between 120 and 160'))
    assert "GreaterThanOrEqual(ts,120), LessThan(ts,160)" in found and "In(series, [a,c])" in found and "PartitionFilters: [isnotnull(shard_start" in found
    assert own.query('select sum(10) from "a", "c" between 120 and 160').agg(F.sum("value")).first()[0] == sum(range(120, 160))


def leaves(df):
    return df._jdf.queryExecution().analyzed().collectLeaves().size()


def test_inserts_do_not_grow_the_plan(spark):
    own = Engine(spark, time_precision="s")
    for k in range(200):
        own.insert({f"s{k % 7}": [[k, k]]})
    assert leaves(own.points()) <= 2
    assert own.run("select count() from *")["s0"] == [[196, 29]]
    own.insert_frame(spark.sql("SELECT 's0' AS series, 500 AS ts, 1.9D AS value"))
    more = leaves(own.points())
    own.insert_frame(spark.sql("SELECT 's0' AS series, 501 AS ts, '33 x' AS value"))
    own.insert({"s0": [[502, "7"]]})
    assert leaves(own.points()) <= more + 4
    assert own.run("select * from /s0/ after 400") == {"s0": [[500, 1], [501, 33], [502, 7]]}


def test_tags_are_semi_joins(spark):
    own = Engine(spark, time_precision="s")
    own.insert({f"s{k}": [[1, k]] for k in range(9)})
    own.run("alter series /s[0-4]/ tag `low`")
    own.run("alter series /s[3-6]/ tag `mid`")
    assert "LeftSemi" in plan(own.query("select * from `low`"))
    assert sorted(own.run("select * from `low` & `mid`")) == ["s3", "s4"] and sorted(own.run('select * from `mid` - `low`, "s0"')) == ["s0", "s5", "s6"]
    own.run("alter series /s3/ untag `low`")
    assert sorted(own.run("select * from `low`")) == ["s0", "s1", "s2", "s4"]
