"""The engine's queries on the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.engine import Engine
from tidewell.sources.points import from_frame, micros
from tidewell.sources.readers import csv_points
from tidewell.sources.store import Store, folder
from tidewell.streaming.ingest import into_store

Make = Callable[[SparkSession, str], DataFrame]
HOUR, DAY = 3_600_000_000, 86_400_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A float series for each event type."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return from_frame(df, F.col("event_type"), micros(F.col("ts")), F.col("value"), "float", F.col("event_id"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A float series for each user."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return from_frame(df, F.concat(F.lit("user-"), F.col("user_id").cast("string")), micros(F.col("ts")), F.col("value"), "float", F.col("event_id"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An integer series of quantities for each return flag; many points share a day."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    seq = ((F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")) * 4096 + F.col("l_partkey") % 4096) * 64 + F.col("l_quantity").cast("long")
    return from_frame(df, F.col("l_returnflag"), micros(F.col("l_shipdate")), F.col("l_quantity").cast("long"), "integer", seq)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A string series for each language; the time is the document's id."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return from_frame(df, F.col("lang"), F.col("doc_id"), F.col("text"), "string")


TABLES = {"events": (events, "float"), "users": (users, "float"), "lines": (lines, "integer"), "texts": (texts, "string")}


def engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    made = [TABLES[t][0](spark, sf_dir) for t in tables]
    points = made[0]
    for more in made[1:]:
        points = points.unionByName(more)
    return Engine(spark, points, kinds=frozenset(TABLES[t][1] for t in tables), time_precision="us", timezone="UTC")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 7).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def asked(text: str, *tables: str, first: tuple[str, ...] = ()) -> Make:
    """A query that runs a statement, after others with side effects."""

    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = engine(spark, sf_dir, *(tables or ("events",)))
        for before in first:
            own.run(before)
        return rounded(own.query(text))

    return make


SOURCES = """
WITH events_ AS (SELECT event_type AS series, epoch_us(ts) AS ts, event_id AS seq, value FROM events),
users_ AS (SELECT 'user-' || user_id AS series, epoch_us(ts) AS ts, event_id AS seq, value FROM events),
lines_ AS (SELECT l_returnflag AS series, epoch_us(l_shipdate) AS ts, ((l_orderkey * 8 + l_linenumber) * 4096 + l_partkey % 4096) * 64 + CAST(l_quantity AS BIGINT) AS seq, CAST(l_quantity AS BIGINT) AS value FROM lineitem),
texts_ AS (SELECT lang AS series, doc_id AS ts, 0 AS seq, text AS value FROM documents)
"""
RECURSIVE = SOURCES.replace("WITH events_", "WITH RECURSIVE events_", 1)
Pair = tuple[Make, str]
FOUND: dict[str, Pair] = {}


def add(name: str, make: Make, sql: str, prelude: str = SOURCES) -> None:
    FOUND[name] = (make, prelude + sql)


def label(g: int) -> str:
    return f"((ts + {g - 1}) // {g}) * {g}"


VAR = "CASE WHEN count(*) = 1 THEN 0.0 ELSE {}(value) END"
DOUBLES = {
    "mean": "avg(value)", "median": "quantile_cont(value, 0.5)", "variance": VAR.format("var_samp"), "pvariance": "var_pop(value)", "stddev": VAR.format("stddev_samp"),
}
SAME = {
    "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "median_low": "quantile_disc(value, 0.5)", "first": "arg_min(value, (ts, seq))", "last": "arg_max(value, (ts, seq))",
    "median_high": "list_sort(list(value))[count(*) // 2 + 1]",
}
for _name, _sql in {**DOUBLES, **SAME, "count": "count(*)"}.items():
    _exact = _name == "count"
    _value = _sql if _exact else f"round({_sql}, 7)"
    add(f"{_name}_g", asked(f"select {_name}(1h) from *"), f"SELECT series, {label(HOUR)} AS ts, {_value} AS value FROM events_ GROUP BY 1, 2")
    _ts = "min(ts)" if _name == "first" else "max(ts)"
    add(f"{_name}_all", asked(f"select {_name}() from *", "users"), f"SELECT series, {_ts} AS ts, {_value} AS value FROM users_ GROUP BY 1")
    _int = f"round({_sql}, 7)" if _name in DOUBLES else f"CAST({_sql} AS BIGINT)"
    add(f"{_name}_g_integer", asked(f"select {_name}(4w) from *", "lines"), f"SELECT series, {label(28 * DAY)} AS ts, {_int} AS value FROM lines_ GROUP BY 1, 2")

add("difference_g", asked("select difference(1h) from *"), f"SELECT series, {label(HOUR)} AS ts, round(arg_max(value, (ts, seq)) - arg_min(value, (ts, seq)), 7) AS value FROM events_ GROUP BY 1, 2")
add("difference_g_integer", asked("select difference(4w) from *", "lines"), f"SELECT series, {label(28 * DAY)} AS ts, CAST(arg_max(value, (ts, seq)) - arg_min(value, (ts, seq)) AS BIGINT) AS value FROM lines_ GROUP BY 1, 2")
add("derivative_g", asked("select derivative(1d, 1h) from *"), f"SELECT series, {label(HOUR)} AS ts, round((arg_max(value, (ts, seq)) - arg_min(value, (ts, seq))) * 24.0, 7) AS value FROM events_ GROUP BY 1, 2")
LAG = "SELECT series, ts, value, lag(value) OVER w AS before, ts - lag(ts) OVER w AS gap FROM {} WINDOW w AS (PARTITION BY series ORDER BY ts, seq)"
add("difference", asked("select difference() from *", "users"), f"SELECT series, ts, round(value - before, 7) AS value FROM ({LAG.format('users_')}) WHERE before IS NOT NULL")
add("difference_integer", asked("select difference() from *", "lines"), f"SELECT series, ts, CAST(value - before AS BIGINT) AS value FROM ({LAG.format('lines_')}) WHERE before IS NOT NULL")
add("derivative", asked("select derivative(1h) from *", "users"), f"SELECT series, ts, round((value - before) / gap * {HOUR}.0, 7) AS value FROM ({LAG.format('users_')}) WHERE before IS NOT NULL")
add("interval", asked("select interval() from *", "users"), f"SELECT series, ts, gap AS value FROM ({LAG.format('users_')}) WHERE gap IS NOT NULL")
add("timeval", asked("select timeval() from *", "users"), "SELECT series, ts, ts AS value FROM users_")
add("identity", asked("select * from *", "users"), "SELECT series, ts, round(value, 7) AS value FROM users_")
add("points_identity", asked("select points from *", "users"), "SELECT series, ts, round(value, 7) AS value FROM users_")

for _name, _op in {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "==", "ne": "!="}.items():
    add(f"filter_{_name}", asked(f"select filter({_op} 25) from *", "lines"), f"SELECT series, ts, value FROM lines_ WHERE value {_op} 25")
add("filter_float", asked("select filter(> 50.5) from *"), "SELECT series, ts, round(value, 7) AS value FROM events_ WHERE value > 50.5")
add("filter_cast", asked("select filter(> 25.9) from *", "lines"), "SELECT series, ts, value FROM lines_ WHERE value > 25")
add("filter_nan", asked("select filter(!= nan) => filter(< inf) from *"), "SELECT series, ts, round(value, 7) AS value FROM events_ WHERE NOT isnan(value) AND value < 'inf'::DOUBLE")
add("filter_contains", asked('select filter(~ "the") from *', "texts"), "SELECT series, ts, value FROM texts_ WHERE contains(value, 'the')")
add("filter_lacks", asked('select filter(!~ "the") from *', "texts"), "SELECT series, ts, value FROM texts_ WHERE NOT contains(value, 'the')")
add("filter_regex", asked("select filter(/[A-M].*/) from *", "texts"), "SELECT series, ts, value FROM texts_ WHERE regexp_matches(value, '^[A-M][^\\n]*$')")
add("filter_text", asked('select filter(>= "T") from *', "texts"), "SELECT series, ts, value FROM texts_ WHERE value >= 'T'")

JAN = "epoch_us(TIMESTAMP '2024-01-{}')"
add("after", asked('select * from * after "2024-01-20"'), f"SELECT series, ts, round(value, 7) AS value FROM events_ WHERE ts >= {JAN.format(20)}")
add("before", asked('select * from * before "2024-01-05T12:00:00Z"'), f"SELECT series, ts, round(value, 7) AS value FROM events_ WHERE ts < {JAN.format('05 12:00:00')}")
add("between", asked('select sum(1d) from * between "2024-01-10" and "2024-01-10" + 5d'), f"SELECT series, {label(DAY)} AS ts, round(sum(value), 7) AS value FROM events_ WHERE ts >= {JAN.format(10)} AND ts < {JAN.format(15)} GROUP BY 1, 2")
RANK = "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts {0}, seq {0}) AS k FROM {1}) WHERE k <= {2}"
add("head", asked("select * from * head 7", "users"), f"SELECT series, ts, round(value, 7) AS value FROM ({RANK.format('ASC', 'users_', 7)})")
add("tail", asked("select * from * tail 7", "users"), f"SELECT series, ts, round(value, 7) AS value FROM ({RANK.format('DESC', 'users_', 7)})")
add("tail_mean", asked("select mean() from * tail 50", "lines"), f"SELECT series, max(ts) AS ts, round(avg(value), 7) AS value FROM ({RANK.format('DESC', 'lines_', 50)}) GROUP BY 1")

BY_NAME = "SELECT series, max(ts) AS ts, count(*) AS value FROM users_ WHERE {} GROUP BY 1"
for _name, _match, _test in (
    ("name", '"user-7"', "series = 'user-7'"), ("regex", "/user-1.*/", "regexp_matches(series, '^user-1.*$')"), ("regex_i", "/USER-2[0-9]/i", "regexp_matches(series, '(?i)^USER-2[0-9]$')"),
    ("regex_alternatives", "/user-1|2/", "regexp_matches(series, '^user-1|2$')"),
    ("union", '"user-1", "user-2" | /user-3.*/', "series IN ('user-1', 'user-2') OR series LIKE 'user-3%'"), ("intersection", "/user-1.*/ & /.*5/", "series LIKE 'user-1%' AND series LIKE '%5'"),
    ("difference", "* - /.*[0-4]/", "NOT regexp_matches(series, '[0-4]$')"), ("symmetric", "/user-1.*/ ^ /.*5/", "(series LIKE 'user-1%') <> (series LIKE '%5')"),
    ("parentheses", "all - (/user-1.*/ & (/.*5/ | /.*6/))", "NOT (series LIKE 'user-1%' AND (series LIKE '%5' OR series LIKE '%6'))"),
    ("left_to_right", '/user-1.*/, /user-2.*/ & /.*5/', "(series LIKE 'user-1%' OR series LIKE 'user-2%') AND series LIKE '%5'"),
):
    add(f"set_{_name}", asked(f"select count() from {_match}", "users"), BY_NAME.format(_test))
add("set_group", asked("select count() from `ones` - `fives`", "users", first=("create group `ones` for /user-1.*/", "create group `fives` for /.*5/")), BY_NAME.format("series LIKE 'user-1%' AND series NOT LIKE '%5'"))
add("set_tag", asked("select count() from `some`", "users", first=("alter series /user-1.*/ tag `some`", 'alter series "user-1" untag `some`')), BY_NAME.format("series LIKE 'user-1%' AND series <> 'user-1'"))
add("where_name", asked('select count() from * where name ~ "1" and name != "user-1"', "users"), BY_NAME.format("contains(series, '1') AND series <> 'user-1'"))
CATALOG = ", c AS (SELECT series AS name, count(*) AS length, min(ts) AS start, max(ts) AS \"end\" FROM users_ GROUP BY 1)"
add("where_length", asked("select count() from * where length > 60 and (length < 80 or name == \"user-3\")", "users"), CATALOG + "SELECT name AS series, \"end\" AS ts, length AS value FROM c WHERE length > 60 AND (length < 80 OR name = 'user-3')")
add("where_start", asked('select count() from * where start < "2024-01-01T06:00" and end >= "2024-01-29"', "users"), CATALOG + f"SELECT name AS series, \"end\" AS ts, length AS value FROM c WHERE start < {JAN.format('01 06:00:00')} AND \"end\" >= {JAN.format(29)}")
add("where_type", asked("select count() from * where type == integer", "users", "lines"), "SELECT series, max(ts) AS ts, count(*) AS value FROM lines_ GROUP BY 1")

add("chain_mean_difference", asked("select mean(1d) => difference() from *"), f", m AS (SELECT series, {label(DAY)} AS ts, avg(value) AS value FROM events_ GROUP BY 1, 2) SELECT * FROM (SELECT series, ts, round(value - lag(value) OVER (PARTITION BY series ORDER BY ts), 7) AS value FROM m) WHERE value IS NOT NULL")
add("chain_filter_count", asked("select filter(> 50) => count(1d) from *"), f"SELECT series, {label(DAY)} AS ts, count(*) AS value FROM events_ WHERE value > 50 GROUP BY 1, 2")
_multi = f"SELECT 'lo-' || series AS series, {label(DAY)} AS ts, round(min(value), 7) AS value FROM events_ GROUP BY 1, 2 UNION ALL SELECT series || '-hi', {label(DAY)}, round(max(value), 7) FROM events_ GROUP BY 1, 2"
add("multi_prefix_suffix", asked('select min(1d) prefix "lo-", max(1d) suffix "-hi" from *'), _multi)
add("merge_as", asked('select * from /user-1.*/ merge as "m"', "users"), "SELECT 'm' AS series, ts, round(value, 7) AS value FROM users_ WHERE series LIKE 'user-1%'")
add("merge_using", asked('select sum(1d) from * merge as "total" using sum(1)'), f", s AS (SELECT series, {label(DAY)} AS ts, sum(value) AS value FROM events_ GROUP BY 1, 2) SELECT 'total' AS series, ts, round(sum(value), 7) AS value FROM s GROUP BY 2")
add("merge_promoted", asked('select max(4w) from * merge as "m" using mean(8w)', "events", "lines"), f", s AS (SELECT series, {label(28 * DAY)} AS ts, max(value) AS value FROM events_ GROUP BY 1, 2 UNION ALL SELECT series, {label(28 * DAY)}, CAST(max(value) AS DOUBLE) FROM lines_ GROUP BY 1, 2) SELECT 'm' AS series, {label(56 * DAY)} AS ts, round(avg(value), 7) AS value FROM s GROUP BY 2")

SCAN = """, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts, seq) AS k FROM ({rows})),
s AS (
  SELECT series, k, ts, value, {first} AS label FROM n WHERE k = 1
  UNION ALL
  SELECT n.series, n.k, n.ts, n.value, CASE WHEN n.ts > s.label THEN {next} ELSE s.label END FROM n JOIN s ON n.series = s.series AND n.k = s.k + 1)
"""
_at = "(({0} + {1} - 1) // {1}) * {1} + {2}"
add("offset_bucket", asked("select mean(1d) => offset(5h) from *", "users"), SCAN.format(rows="SELECT * FROM users_", first=_at.format("ts", DAY, 5 * HOUR), next=_at.format("n.ts", DAY, 5 * HOUR)) + "SELECT series, label AS ts, round(avg(value), 7) AS value FROM s GROUP BY 1, 2", RECURSIVE)
_limited = "SELECT u.*, (x.t1 - x.t0) // 20 + 1 AS g, (x.t0 - 1) % ((x.t1 - x.t0) // 20 + 1) AS o FROM users_ AS u JOIN (SELECT series, min(ts) AS t0, max(ts) AS t1, count(*) AS c FROM users_ GROUP BY 1) AS x ON x.series = u.series WHERE x.c > 20"
_scan = SCAN.replace("series, k, ts, value, {first}", "series, k, ts, value, g, o, {first}").replace("n.value, CASE", "n.value, n.g, n.o, CASE")
add(
    "limit_mean", asked("select limit(20, mean) from *", "users"),
    _scan.format(rows=_limited, first=_at.format("ts", "g", "o"), next=_at.format("n.ts", "n.g", "n.o")) + "SELECT series, label AS ts, round(avg(value), 7) AS value FROM s GROUP BY 1, 2 UNION ALL SELECT series, ts, round(value, 7) FROM users_ WHERE series IN (SELECT series FROM users_ GROUP BY 1 HAVING count(*) <= 20)",
    RECURSIVE,
)

add("list_series", asked("list series name, length, start, end, type, shard_duration, pool limit 2147483647", "users", first=("alter database set list_limit 2147483647",)), CATALOG + "SELECT name, length, start, \"end\", 'float' AS type, CAST(604800000000 AS BIGINT) AS shard_duration, 0 AS pool FROM c")
add("list_shards", asked("list shards sid, start, end, size, type, pool limit 10000"), ", x AS (SELECT ts - ts % 604800000000 AS start, count(*) AS n FROM events_ GROUP BY 1) SELECT start AS sid, start, start + 604800000000 AS \"end\", CAST(16 * n AS BIGINT) AS size, 'number' AS type, 0 AS pool FROM x")
add("list_groups", asked("list groups name, expression, series", "users", first=("create group `ones` for /user-1.*/", "create group `none` for /x/")), "SELECT 'ones' AS name, '/user-1.*/' AS expression, count(DISTINCT series) AS series FROM users_ WHERE series LIKE 'user-1%' UNION ALL SELECT 'none', '/x/', 0")
add("list_tags", asked("list tags name, series", "users", first=("alter series /user-1.*/ tag `some`",)), "SELECT 'some' AS name, count(DISTINCT series) AS series FROM users_ WHERE series LIKE 'user-1%'")
add("list_pools", asked("list pools", "users"), "SELECT 0 AS pool, 1 AS servers, count(DISTINCT series) AS series FROM users_")
add("list_users", asked("list users", "users", first=('create user "ann" set password "secret"', 'grant read, insert to user "ann"')), "SELECT 'admin' AS name, 'full' AS access UNION ALL SELECT 'ann', 'write'")
add("count_series", asked("count series /user-1.*/ where length > 60", "users"), CATALOG + "SELECT count(*) AS series FROM c WHERE name LIKE 'user-1%' AND length > 60")
add("count_series_length", asked("count series length /user-1.*/", "users"), "SELECT count(*) AS series_length FROM users_ WHERE series LIKE 'user-1%'")
add("count_shards", asked("count shards"), "SELECT count(DISTINCT ts // 604800000000) AS shards FROM events_")
add("count_shards_size", asked("count shards size"), "SELECT CAST(16 * count(*) AS BIGINT) AS shards_size FROM events_")
add("count_groups", asked("count groups where series > 0", "users", first=("create group `ones` for /user-1.*/", "create group `none` for /x/")), "SELECT CAST(1 AS BIGINT) AS groups")
add("count_tags", asked("count tags", "users", first=("alter series /user-1.*/ tag `some`",)), "SELECT CAST(1 AS BIGINT) AS tags")
add("count_users", asked("count users", "users"), "SELECT CAST(1 AS BIGINT) AS users")
add("count_pools", asked("count pools where series > 0", "users"), "SELECT CAST(1 AS BIGINT) AS pools")
add("count_servers", asked("count servers", "users"), "SELECT CAST(1 AS BIGINT) AS servers")
add("calc", asked('"2013-02-06T13:01:12Z" + 2 * 3d'), "SELECT epoch_us(TIMESTAMP '2013-02-06 13:01:12') + 6 * 86400000000 AS calc")
add("show", asked("show time_precision, list_limit"), "SELECT 'time_precision' AS name, 'us' AS value UNION ALL SELECT 'list_limit', '10000'")
add("drop_series", asked("select count() from *", "users", first=("drop series /user-1.*/",)), BY_NAME.format("series NOT LIKE 'user-1%'"))
add("drop_shards", asked("select count() from *", "users", first=('drop shards where end < "2024-01-15"',)), "SELECT series, max(ts) AS ts, count(*) AS value FROM users_ WHERE ts - ts % 604800000000 + 604800000000 >= " + JAN.format(15) + " GROUP BY 1")


def output_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(engine(spark, sf_dir, "events").query("select max(1d) from *", precision="ms"))


add("output_precision", output_precision, f"SELECT series, ({label(DAY)}) // 1000 AS ts, round(max(value), 7) AS value FROM events_ GROUP BY series, {label(DAY)}")


def fluent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(engine(spark, sf_dir, "events").series("/.*/").after("2024-01-10").mean("1d").frame())


add("fluent", fluent, f"SELECT series, {label(DAY)} AS ts, round(avg(value), 7) AS value FROM events_ WHERE ts >= {JAN.format(10)} GROUP BY 1, 2")


def coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts of mixed types: each series keeps the type of its first value."""
    own = Engine(spark, time_precision="s")
    own.insert({"i": [[1, 7], [2, 35.6], [3, "-50%"], [4, "x"], [5, "99999999999999999999"]]})
    return own.query('select * from "i" where type == integer')


add("insert_coercion", coercion, "SELECT * FROM (VALUES ('i', 1, 7), ('i', 2, 35), ('i', 3, -50), ('i', 4, 0), ('i', 5, 9223372036854775807)) AS t(series, ts, value)")


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole table inserted as a frame, its floats into series that are integer already."""
    own = Engine(spark, time_precision="us")
    own.insert({name: [[0, 0]] for name in ("view", "click")})
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    own.insert_frame(df.select(F.col("event_type").alias("series"), micros(F.col("ts")).alias("ts"), "value", F.col("event_id").alias("seq")))
    found = own.query("select sum(1d) from * after 1")
    return rounded(found.select("series", "ts", "type", F.coalesce(F.col("value_integer").cast("double"), "value_float").alias("value")))


_kept = "CASE WHEN series IN ('view', 'click') THEN {} ELSE {} END"
add("insert_frame", framed, f"SELECT series, {label(DAY)} AS ts, {_kept.format(repr('integer'), repr('float'))} AS type, round(sum({_kept.format('trunc(value)', 'value')}), 7) AS value FROM events_ GROUP BY 1, 2")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written in time slices; the range reads only the slices it meets."""
    store = Store(spark, folder(spark, "points"), 7 * DAY)
    store.append(events(spark, sf_dir))
    own = Engine(spark, kinds={"float"}, store=store, time_precision="us", timezone="UTC")
    return rounded(own.query('select count(1d) from * between "2024-01-10" and "2024-01-20"'))


add("stored_slices", stored, f"SELECT series, {label(DAY)} AS ts, count(*) AS value FROM events_ WHERE ts >= {JAN.format(10)} AND ts < {JAN.format(20)} GROUP BY 1, 2")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream into the store, then a query."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = from_frame(raw, F.col("event_type"), micros(F.col("ts")), F.col("value"), "float", F.col("event_id"))
    path = folder(spark, "points")
    store = Store(spark, path, 7 * DAY)
    into_store(stream, store, f"{path}-progress").awaitTermination()
    return rounded(Engine(spark, kinds={"float"}, store=store, time_precision="us").query("select sum(1d) from *"))


add("stream_ingest", streamed, f"SELECT series, {label(DAY)} AS ts, round(sum(value), 7) AS value FROM events_ GROUP BY 1, 2")



def inserted(data: list, text: str, first: tuple[str, ...] = (), **options) -> Make:
    """A statement on an engine of its own that got each of data by one insert."""

    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = Engine(spark, **{"time_precision": "s", "timezone": "UTC", **options})
        for each in data:
            own.insert(each)
        for before in first:
            own.run(before)
        return own.query(text)

    return make


def values(*rows: tuple, columns: str = "series, ts, value") -> str:
    return f"SELECT * FROM (VALUES {', '.join(repr(r) for r in rows)}) AS t({columns})"


THREE = [{"ab": [[1, 1], [2, 2]], "ac": [[3, 3]], "b": [[4, 4]]}]
add("insert_array", inserted([[{"name": "x", "points": [[2, 5], [1, 4]]}, {"name": "y", "points": [[1, 9]]}]], "select * from * where type == integer"), values(("x", 1, 4), ("x", 2, 5), ("y", 1, 9)), "")
add("insert_many_times", inserted([{f"s{k % 3}": [[k, k]]} for k in range(200)], "select sum(100) from * where type == integer"), "SELECT 's' || k % 3 AS series, (k + 99) // 100 * 100 AS ts, CAST(sum(k) AS BIGINT) AS value FROM range(200) AS t(k) GROUP BY 1, 2", "")
add("comments_and_now", inserted([{"old": [[5, 1]], "new": [[4000000000, 2]]}], "select * from * where type == integer before now  # not what is to come"), values(("old", 5, 1)), "")
add("merge_nothing_matched", inserted(THREE, 'select sum(10) from "none" where type == integer merge as "m"'), values(("m", 1, 1)) + " WHERE FALSE", "")
add("alter_group", inserted(THREE, "select count() from `h`", ("create group `g` for /b/", "alter group `g` set expression /a.*/", "alter group `g` set name \"h\"")), values(("ab", 2, 2), ("ac", 3, 1)), "")
add("drop_group", inserted(THREE, "list groups name, series", ("create group `g` for /b/", "create group `h` for /a.*/", "drop group `g`")), values(("h", 2), columns="name, series"), "")
add("alter_tag", inserted(THREE, "select count() from `u` - /.*c/", ("alter series /a.*/ tag `t`", 'alter tag `t` set name "u"')), values(("ab", 2, 2)), "")
add("drop_tag", inserted(THREE, "list tags name, series", ("alter series /a.*/ tag `t`", 'alter series "b" tag `u`', "drop tag `t`")), values(("u", 1), columns="name, series"), "")
add("tag_props", inserted(THREE, "list tags name, series where series > 1", ("alter series /a.*/ tag `t`", 'alter series "b" tag `u`')), values(("t", 2), columns="name, series"), "")
add("set_tags_mixed", inserted(THREE, "select count() from (`t` ^ `u`) | /b/", ("alter series /a.*/ tag `t`", "alter series /ac/ tag `u`")), values(("ab", 2, 2), ("b", 4, 1)), "")
add("user_props", inserted(THREE, "list users where access >= insert", ('create user "ann" set password "secret"', 'grant read, insert to user "ann"', 'create user "bob" set password "secret"', 'grant show to user "bob"')), values(("admin", "full"), ("ann", "write"), columns="name, access"), "")
_slots = """
SELECT name, CASE WHEN h % 2 = 0 THEN CASE WHEN (h // 2 + 1) % 3 = 0 THEN 2 ELSE 0 END ELSE CASE WHEN ((h + 1) // 2 + 1) % 3 = 0 THEN 2 ELSE 1 END END AS pool
FROM (SELECT name, CAST(list_sum([ascii(c) FOR c IN string_split(name, '')]) % 8192 AS BIGINT) AS h FROM (VALUES ('ab'), ('ac'), ('b')) AS t(name))"""
add("pool_hash", inserted(THREE, "list series name, pool", pools=3), _slots, "")
add("expiration_on_write", inserted([{"a": [[1000, 1]]}, {"a": [[4000000000, 2]]}], "select * from * where type == integer", expiration_num=3600), values(("a", 4000000000, 2)), "")
add("alter_database", inserted(THREE, "show drop_threshold, timezone", ("alter database set drop_threshold 0.5", "alter database set timezone 'Europe/Berlin'")), values(("drop_threshold", "0.5"), ("timezone", "Europe/Berlin"), columns="name, value"), "")


def csv_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file of points, written first, inserted as a frame."""
    path = folder(spark, "csv")
    events(spark, sf_dir).select("series", "ts", F.col("vd").alias("value")).write.csv(path, header=True)
    own = Engine(spark, time_precision="us", timezone="UTC")
    own.insert_frame(csv_points(spark, path))
    return rounded(own.query("select sum(1d) from * where type == float"))


add("csv_insert", csv_insert, f"SELECT series, {label(DAY)} AS ts, round(sum(value), 7) AS value FROM events_ GROUP BY 1, 2")


def teed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second sink got of inserts."""
    got: list[DataFrame] = []
    own = Engine(spark, time_precision="s")
    own.tees.append(lambda fresh: got.append(fresh.select("series", "ts", F.col("vi").alias("value"))))
    own.insert({"i": [[1, 7], [2, "8 x"]]})
    own.insert({"i": [[3, 9.7]]})
    return got[0].unionByName(got[1])


add("tee", teed, values(("i", 1, 7), ("i", 2, 8), ("i", 3, 9)), "")

QUERIES: dict[str, Make] = {name: make for name, (make, _) in FOUND.items()}
SQL: dict[str, str] = {name: sql for name, (_, sql) in FOUND.items()}
