import pytest

from tidewell.catalog import access_text, bits, lookup, pool_of
from tidewell.errors import QueryError
from tidewell.plans import ast
from tidewell.plans.fold import date_seconds, fold, zone
from tidewell.plans.parser import parse


@pytest.mark.parametrize("text", ["5+37", "2+2*20", "(2+4)*7", "16%10*7", "7*14%56", "21/3*6", "22/3*6", "-(-42)"])
def test_arithmetic(text):
    assert fold(text) == 42


def test_whole_division_cuts_toward_zero():
    assert fold("(0-7)/2") == -3 and fold("(0-7)%2") == -1


@pytest.mark.parametrize("text", ["42/(2-2)", "42%(2-2)"])
def test_zero_division(text):
    with pytest.raises(QueryError):
        fold(text)


@pytest.mark.parametrize(
    "text, tz, seconds",
    [("2013", "Europe/Amsterdam", 1356994800), ("2013+01", "UTC", 1356994800), ("2013Z", "Europe/Amsterdam", 1356998400), ("2013-02-06T13:01:12", "UTC", 1360155672), ("2013-2-6 13:1:12", "utc", 1360155672), ("2016-04-21", "europe/amsterdam", 1461189600), ("2013-12-31", "NAIVE", 1388448000), ("2013-02-06-02:30", "UTC", 1360108800 + 9000)],
)
def test_dates(text, tz, seconds):
    assert date_seconds(text, zone(tz)) == seconds


@pytest.mark.parametrize("text", ["2016 04 21", "x", "2013-13", "2013-02-30"])
def test_bad_dates(text):
    with pytest.raises(QueryError):
        date_seconds(text, zone("UTC"))


def test_precedence():
    where = parse("list series where length > 1 and name == 'a' or pool == 0").body.where
    assert where.op == "or" and where.left.op == "and"
    match = parse('select * from "a", "b" & "c"').body.match
    assert match == ast.SetOp("intersection", ast.SetOp("union", ast.Name("a"), ast.Name("b")), ast.Name("c"))


@pytest.mark.parametrize("text", ["select", "select mean(1h) from", "list", "select * from * limit 3", "drop series", "alter group x set name 'a'", "select foo() from *", "count nothing", "select * from * where length ~ 3", "select * from * after"])
def test_refused(text):
    with pytest.raises(QueryError, match="Query error at position"):
        parse(text)


@pytest.mark.parametrize(
    "text",
    [
        "alter user 'a' set password 'abcd'", "alter tag `t` set name 'u'", "drop shards where end < now - 7d set ignore_threshold true", "alter database set tee false", "alter database set expiration_log 2w set ignore_threshold false",
        "revoke all_ from user 'x'" if False else "revoke read from user 'x'", "list servers name, uptime where online == true", "count servers received_points", "count shards size where type == number", "alter servers set log_level debug", "show", "?", "help select",
        "select all => points from all where shard_duration >= 1d before now", "select limit(2 * 3, median_low) => filter(== 'x') from 'a' union 'b' tail 4", "select filter(- inf) from *", "select filter(-3) => filter(.5) from *",
    ],
)
def test_accepted(text):
    assert parse(text).body is not None


def test_pools(spark):
    assert "".join(map(str, lookup(4)[:30])) == "010231033221010231033221010231"
    for n in (2, 5, 20, 42):
        slots = lookup(n)
        assert all(abs(slots.count(p) - len(slots) / n) <= 0.2 * len(slots) / n for p in range(n))

    def brute(name):
        return lookup(4)[sum(b - 256 if b > 127 else b for b in name.encode()) % (1 << 32) % 8192]

    names = ["", "a", "cpu load", "ümlaut", "€" * 9, "ÿ" * 300]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in df.select(pool_of(df["name"], 4)).collect()] == [brute(n) for n in names]


def test_access():
    assert access_text(bits(["full"])) == "full" and access_text(0) == "no access" and access_text(bits(["select", "list", "alter"])) == "list, select and alter"
    assert access_text(bits(["read", "alter"])) == "read and alter"
