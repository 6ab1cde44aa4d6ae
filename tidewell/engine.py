"""The engine: statements in, DataFrames out."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace
from typing import Any

import pyspark
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from tidewell import __version__
from tidewell.catalog import ACCESS, Names, Options, Users, access_text, bits, pool_of, series_catalog, shard_catalog
from tidewell.errors import AccessError, InsertError, QueryError
from tidewell.functions.chain import Kinds
from tidewell.help import topic
from tidewell.operators import select as selects
from tidewell.operators.series_set import anchored, condition, predicate, props_in, refs_in
from tidewell.plans import ast
from tidewell.plans.fold import PRECISIONS, Clock, zone
from tidewell.plans.parser import COLUMNS, SHOWN, parse
from tidewell.sources.ingest import STAGED, coerced, rows, types_of
from tidewell.sources.points import KINDS, VALUE, empty
from tidewell.sources.readers import staged_frame
from tidewell.sources.store import Store, folder
from tidewell.streaming.tee import parsed, tcp_tee

DEFAULT_COLUMNS = {"series": ("name",), "shards": tuple("sid pool server start end".split()), "groups": ("name",), "tags": ("name",), "pools": ("pool", "servers", "series"), "users": ("name", "access"), "servers": tuple("name pool version online status".split())}
UNLIMITED_ROWS = 1000
NAME_LENGTH = 255
Change = Callable[[DataFrame], DataFrame]


#: Inserted points that wait in the driver before they are written.
BUFFER = 100_000


class Engine:
    """points: a frame as in sources/points.py, or none; kinds: the types it may have; store: where inserts are kept.

    Without a store small inserts wait in a buffer, as one local relation of any plan, and larger ones go to a store of the session."""

    def __init__(self, spark: SparkSession, points: DataFrame | None = None, kinds: Kinds = KINDS, store: Store | None = None, user: str | None = None, **options: Any) -> None:
        self.spark, self.kinds, self.store, self.user = spark, frozenset(kinds), store, user
        self.options = Options(**options)
        if self.options.time_precision not in PRECISIONS:
            raise QueryError(f"Unknown time precision: '{self.options.time_precision}'")
        self.names, self.users = Names(), Users()
        self._points = points
        self._own: Store | None = None
        self._buffer: list[tuple] = []
        self._waiting: DataFrame | None = None
        self.next_seq, self.received, self.selected, self.started = 0, 0, 0, time.time()
        self.tees: list[Callable[[DataFrame], None]] = []

    # points

    @property
    def factor(self) -> int:
        return PRECISIONS[self.options.time_precision]

    def points(self, span: ast.Span | None = None) -> DataFrame:
        if self.store is not None:
            return self.store.read(span)
        parts = [self._points] if self._points is not None else []
        if self._own is not None:
            parts.append(self._own.read(span))
        if self._buffer:
            if self._waiting is None:
                self._waiting = self._coerced(self.spark.createDataFrame(self._buffer, STAGED))
            parts.append(self._waiting)
        out = parts[0] if parts else empty(self.spark)
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def insert(self, data: Any) -> dict:
        """Checks, coerces and keeps points; data is a map name -> points or an array of name and points."""
        self._may("insert")
        found = list(rows(data, self._most_ts, self.next_seq))
        self.next_seq += len(found)
        self.received += len(found)
        straight = self.store is not None or self.tees or self.options.tee or self.options.expiration_num or self.options.expiration_log
        if straight:
            self._flush()
            self._add(self.spark.createDataFrame(found, STAGED))
        else:
            self._buffer += found
            self._waiting = None
            if len(self._buffer) > BUFFER:
                self._flush()
        return {"success_msg": f"Successfully inserted {len(found)} point(s)."}

    def insert_frame(self, df: DataFrame) -> None:
        """Points of a frame with series, ts, value and perhaps seq, checked and coerced where they are."""
        self._may("insert")
        self._flush()
        try:
            self._add(staged_frame(df, self._most_ts, self.next_seq))
        except PySparkException as e:
            raise InsertError(_message(e)) from e
        self.next_seq += 1

    @property
    def _most_ts(self) -> int:
        return (1 << 32) - 1 if self.options.time_precision == "s" else (1 << 63) - 1

    def _target(self) -> Store:
        """Where points are written."""
        if self.store is not None:
            return self.store
        if self._own is None:
            self._own = Store(self.spark, folder(self.spark, "session"), self.options.duration_num * self.factor)
        return self._own

    def _coerced(self, stage: DataFrame) -> DataFrame:
        """Points of the types that their series have; types are read from their own table, points only of a frame that was given."""
        known = None
        if self.store is not None or self._own is not None:
            known = self._target().types()
        if self.store is None and self._points is not None:
            given = types_of(self._points.join(stage.select("series").distinct(), "series", "left_semi"))
            known = given if known is None else types_of(given.unionByName(known))
        return coerced(stage, known)

    def _flush(self) -> None:
        """What waits is written."""
        if self._buffer and self.store is None:
            stage, self._buffer, self._waiting = self.spark.createDataFrame(self._buffer, STAGED), [], None
            self._target().append(self._coerced(stage))

    def _add(self, stage: DataFrame) -> None:
        fresh = self._unexpired(self._coerced(stage))
        for tee in self.tees:
            tee(fresh)
        if self.options.tee:
            tcp_tee(fresh, self.options.tee)
        self._target().append(fresh)

    def _old(self) -> Column:
        """Whether a point's slice has ended before its expiration."""
        old = F.lit(False)
        for log, name in ((False, "num"), (True, "log")):
            age = getattr(self.options, f"expiration_{name}")
            if age:
                width = getattr(self.options, f"duration_{name}") * self.factor
                end = F.col("ts") - F.pmod(F.col("ts"), F.lit(width)) + width
                old = old | ((end < self.clock().now - age) & ((F.col("tp") == "string") == F.lit(log)))
        return old

    def _unexpired(self, points: DataFrame) -> DataFrame:
        """Without the slices that have ended before their expiration."""
        return points.where(~self._old())

    # statements

    def clock(self) -> Clock:
        return Clock(self.options.time_precision, zone(self.options.timezone))

    def query(self, text: str, precision: str | None = None) -> DataFrame:
        """The statement's result as a DataFrame; precision: that of the times in it, else the database's."""
        return self._run(parse(text, self.clock()), precision)

    def statement(self, body: Any) -> DataFrame:
        return self._run(ast.Statement(body), None)

    def run(self, text: str, precision: str | None = None) -> dict:
        """The statement's result collected: a map of series to points, columns and rows, or a message."""
        begun = time.perf_counter()
        stmt = parse(text, self.clock())
        try:
            out = self._collected(stmt, precision)
        except PySparkException as e:
            raise QueryError(_message(e)) from e
        if stmt.timed:
            out["__timeit__"] = [{"server": self.options.dbname, "time": time.perf_counter() - begun}]
        return out

    def _run(self, stmt: ast.Statement, precision: str | None) -> DataFrame:
        body = stmt.body
        scale = PRECISIONS[precision or self.options.time_precision] / self.factor
        if isinstance(body, ast.Select):
            self._may("select")
            found = self.select(body)
            return _scaled(found.frame(), scale)
        if isinstance(body, ast.Listing):
            self._may("list")
            return self.list(body)
        if isinstance(body, ast.Count):
            self._may("count")
            return self.count(body)
        if isinstance(body, ast.Calc):
            return self.spark.range(1).select(F.lit(int(body.value * scale)).cast("long").alias("calc"))
        if isinstance(body, ast.Show):
            self._may("show")
            return self._rows([(p, str(self.property(p))) for p in body.props or SHOWN], "name string, value string")
        if isinstance(body, ast.Help):
            return self._rows([(topic(body.topic),)], "help string")
        if isinstance(body, ast.Change):
            self._may(body.verb)
            return self._rows([(self.change(body),)], "success_msg string")
        return self._rows([], "nothing string")

    def _collected(self, stmt: ast.Statement, precision: str | None) -> dict:
        body = stmt.body
        if isinstance(body, ast.Select):
            self._may("select")
            out = self._declared(body)
            limit = self.options.select_points_limit
            points = self.select(body).points
            rows = points.limit(limit + 1).collect() if limit is not None else points.collect()
            if limit is not None and len(rows) > limit:
                raise QueryError(f"Query has reached the maximum number of selected points ({limit}). Please use another time window, an aggregation function or select less series to reduce the number of points.")
            self.selected += len(rows)
            rows.sort(key=lambda r: (r["ts"], r["origin"], r["seq"]))
            up, down = PRECISIONS[precision or self.options.time_precision], self.factor
            for row in rows:
                out.setdefault(row["series"], []).append([row["ts"] * up // down, row[VALUE[row["tp"]]]])
            return out
        frame = self._run(stmt, precision)
        rows = frame.collect()
        if isinstance(body, ast.Listing):
            return {"columns": frame.columns, body.entity: [list(r) for r in rows]}
        if isinstance(body, (ast.Count, ast.Calc, ast.Change, ast.Help)):
            return rows[0].asDict()
        if isinstance(body, ast.Show):
            return {"data": [r.asDict() for r in rows]}
        return {}

    def _declared(self, stmt: ast.Select) -> dict:
        """The names that the result has, points or not."""
        if stmt.merge:
            return {i.prefix + stmt.merge.name + i.suffix: [] for i in stmt.items}
        names = [r["series"] for r in self.matched(stmt.match, stmt.where).select("series").distinct().collect()]
        return {i.prefix + n + i.suffix: [] for n in sorted(names) for i in stmt.items}

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    # series

    def _among(self, points: DataFrame, match: Any) -> DataFrame:
        """The points whose series are in a set. Tags are tables: one alone is a semi join, in a larger set it marks the series."""
        if match is None or isinstance(match, ast.All):
            return points
        marks: dict[str, str] = {}
        for name in sorted(refs_in(match)):
            if name not in self.names.groups and name not in self.names.tags:
                raise QueryError(f"Cannot find group or tag '{name}'")
            if name not in self.names.groups:
                if isinstance(match, ast.Ref):
                    return points.join(self.names.tags[name], "series", "left_semi")
                marks[name] = f"_tag_{len(marks)}"
                points = points.join(self.names.tags[name].select("series", F.lit(True).alias(marks[name])), "series", "left")
        test = lambda name: (lambda c: F.col(marks[name]).isNotNull()) if name in marks else (lambda c: c.rlike(anchored(self.names.groups[name])))
        return points.where(predicate(match, F.col("series"), test)).drop(*marks.values())

    def catalog(self, match: Any = None, where: Any = None) -> DataFrame:
        """Metadata of the series that match; names and types are tested before anything is summed up."""
        found = series_catalog(self._among(self.points(), match), self.options, self.factor)
        return found if where is None else found.where(condition(where, lambda p: F.col(f"`{p}`")))

    def matched(self, match: Any, where: Any = None, span: ast.Span | None = None) -> DataFrame:
        """The points of the series that match."""
        points = self._among(self.points(span), match)
        if where is None:
            return points
        direct = {"name": F.col("series"), "type": F.col("tp"), "pool": pool_of(F.col("series"), self.options.pools)}
        if props_in(where) <= set(direct):
            return points.where(condition(where, direct.__getitem__))
        names = self.catalog(match, where).select(F.col("name").alias("series"))
        return points.join(names, "series", "left_semi")

    def select(self, stmt: ast.Select) -> selects.Result:
        kinds = self.kinds
        if isinstance(stmt.where, ast.Compare) and stmt.where.prop == "type":
            only = frozenset({stmt.where.value})
            kinds = (kinds & only if stmt.where.op == "==" else kinds - only) or kinds
        points = selects.in_span(self.matched(stmt.match, stmt.where, stmt.span), stmt.span)
        return selects.select(points, kinds, stmt)

    # lists and counts

    def entity(self, name: str, match: Any = None, where: Any = None) -> DataFrame:
        """A catalog table with its condition applied."""
        if name == "series":
            return self.catalog(match, where)
        if name == "shards":
            df = shard_catalog(self.points(), self.options, self.factor)
        elif name == "groups":
            df = self._groups()
        elif name == "tags":
            df = self._tags()
        elif name == "pools":
            own = self._rows([(p, 1) for p in range(self.options.pools)], "pool int, servers int")
            n = self.catalog().groupBy("pool").agg(F.count(F.lit(1)).alias("series"))
            df = own.join(n, "pool", "left").select("pool", "servers", F.coalesce("series", F.lit(0).cast("long")).alias("series"))
        elif name == "users":
            rows = sorted((n, access_text(b), b) for n, (b, _) in self.users.rows.items())
            df = self._rows(rows, "name string, access string, bits int")
            if where is not None:
                df = df.where(condition(_access_bits(where), lambda p: F.col("bits" if p == "access" else p)))
            return df.select("name", "access")
        else:
            df = self.spark.range(1).select(*[F.lit(self.property(c) if c not in ("name", "online", "address", "port") else {"name": self.options.dbname, "online": True, "address": "localhost", "port": 0}[c]).alias(c) for c in COLUMNS["servers"]])
        return df if where is None else df.where(condition(where, lambda p: F.col(f"`{p}`")))

    def _groups(self) -> DataFrame:
        rows = sorted((n, f"/{r.text}/{'i' if r.ignore_case else ''}") for n, r in self.names.groups.items())
        own = self._rows(rows, "name string, expression string")
        if not rows:
            return own.withColumn("series", F.lit(0).cast("long"))
        hits = F.array(*[F.when(F.col("series").rlike(anchored(r)), F.lit(n)) for n, r in sorted(self.names.groups.items())])
        n = self.points().select("series").distinct().select(F.explode(F.array_compact(hits)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("series"))
        return own.join(n, "name", "left").select("name", "expression", F.coalesce("series", F.lit(0).cast("long")).alias("series"))

    def _tags(self) -> DataFrame:
        own = self._rows(sorted((n,) for n in self.names.tags), "name string")
        pairs = self._rows([], "name string, series string")
        for name, found in self.names.tags.items():
            pairs = pairs.unionByName(found.select(F.lit(name).alias("name"), "series"))
        there = self.points().select("series").distinct()
        n = pairs.join(there, "series", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("series"))
        return own.join(n, "name", "left").select("name", F.coalesce("series", F.lit(0).cast("long")).alias("series"))

    def list(self, stmt: ast.Listing) -> DataFrame:
        limit = stmt.limit
        if limit is not None and not 1 <= limit <= self.options.list_limit:
            raise QueryError(f"Limit must be a value between 1 and {self.options.list_limit} but received: {limit} (optionally the limit can be changed, see 'help alter database')")
        found = self.entity(stmt.entity, stmt.match, stmt.where)
        columns = stmt.columns or DEFAULT_COLUMNS[stmt.entity]
        return found.select(*[f"`{c}`" for c in columns]).limit(min(UNLIMITED_ROWS, self.options.list_limit) if limit is None else limit)

    def count(self, stmt: ast.Count) -> DataFrame:
        found = self.entity(stmt.entity, stmt.match, stmt.where)
        if stmt.what == "length":
            return found.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("series_length"))
        if stmt.what == "size":
            return found.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("shards_size"))
        if stmt.what:
            return found.agg(F.coalesce(F.sum(stmt.what), F.lit(0)).cast("long").alias(f"servers_{stmt.what}"))
        return found.agg(F.count(F.lit(1)).alias(stmt.entity))

    def property(self, name: str) -> Any:
        """A property of the database or of this session."""
        if hasattr(self.options, name) and name != "select_points_limit":
            value = getattr(self.options, name)
            return "disabled" if value is None else value
        own: dict[str, Any] = {
            "select_points_limit": self.options.select_points_limit or 1_000_000, "version": __version__, "who_am_i": self.user or "admin", "server": self.options.dbname, "status": "running", "pool": 0,
            "received_points": self.received, "selected_points": self.selected, "startup_time": int(self.started), "uptime": int(time.time() - self.started), "libuv": f"spark {pyspark.__version__}",
            "dbpath": self.store.path if self.store else "", "buffer_path": "", "buffer_size": 0, "active_handles": 0, "active_tasks": 0, "fifo_files": 0, "idle_percentage": 0, "idle_time": 0, "ip_support": "ALL",
            "max_open_files": 0, "mem_usage": 0, "open_files": 0, "reindex_progress": "not available", "sync_progress": "not available",
        }
        return own[name]

    # changes

    def _may(self, what: str) -> None:
        if self.user is not None and not self.users.rows.get(self.user, (0, ""))[0] & ACCESS[what]:
            raise AccessError(f"Access denied, user '{self.user}' has no '{what}' privileges.")

    def change(self, stmt: ast.Change) -> str:
        return getattr(self, f"_{stmt.verb}_{stmt.entity}")(stmt)

    def _create_group(self, stmt: ast.Change) -> str:
        _named(stmt.name, "Group")
        if stmt.name in self.names.groups:
            raise QueryError(f"Group '{stmt.name}' already exists.")
        self.names.groups[stmt.name] = stmt.values["expression"]
        return f"Successfully created group '{stmt.name}'."

    def _drop_group(self, stmt: ast.Change) -> str:
        self.names.need_group(stmt.name)
        del self.names.groups[stmt.name]
        return f"Successfully dropped group '{stmt.name}'."

    def _alter_group(self, stmt: ast.Change) -> str:
        old = self.names.need_group(stmt.name)
        if "expression" in stmt.values:
            self.names.groups[stmt.name] = stmt.values["expression"]
            return f"Successfully updated group '{stmt.name}'."
        new = _named(stmt.values["name"], "Group")
        if new in self.names.groups:
            raise QueryError(f"Group '{new}' already exists.")
        del self.names.groups[stmt.name]
        self.names.groups[new] = old
        return f"Successfully updated group '{new}'."

    def _drop_tag(self, stmt: ast.Change) -> str:
        self.names.need_tag(stmt.name)
        del self.names.tags[stmt.name]
        return f"Successfully dropped tag '{stmt.name}'."

    def _alter_tag(self, stmt: ast.Change) -> str:
        old, new = self.names.need_tag(stmt.name), _named(stmt.values["name"], "Tag")
        if new in self.names.tags or new in self.names.groups:
            raise QueryError(f"Tag '{new}' already exists.")
        del self.names.tags[stmt.name]
        self.names.tags[new] = old
        return f"Successfully updated tag '{new}'."

    def _alter_series(self, stmt: ast.Change) -> str:
        (how, tag), = stmt.values.items()
        if how == "tag" and tag in self.names.groups:
            raise QueryError(f"Cannot create tag `{tag}` because a group with this name already exists.")
        if how == "untag":
            self.names.need_tag(tag)
        found = self._noted(self.catalog(stmt.match, stmt.where).select(F.col("name").alias("series")))
        if tag in self.names.tags:
            old = self.names.tags[tag]
            self.names.tags[tag] = self._noted(old.unionByName(found).distinct() if how == "tag" else old.join(found, "series", "left_anti"))
        else:
            self.names.tags[tag] = found
        return f"Successfully {how}ged {found.count()} series."

    def _noted(self, names: DataFrame) -> DataFrame:
        """A table of names as they are now."""
        path = folder(self.spark, "tag")
        names.write.parquet(path)
        return self.spark.read.schema("series string").parquet(path)

    def _remove(self, gone: Change, kept: Change) -> None:
        """Without some points; gone and kept give those of a frame of points that go and stay. Frames that were given become a store of the session."""
        if self.store is None and (self._points is not None or self._buffer):
            fresh = Store(self.spark, folder(self.spark, "session"), self.options.duration_num * self.factor)
            fresh.append(kept(self.points()))
            self._points, self._buffer, self._waiting, self._own = None, [], None, fresh
        else:
            self._target().remove(gone, kept)

    def _guard(self, dropped: int, total: int, ignore: bool, what: str) -> None:
        if total and not ignore and dropped / total >= self.options.drop_threshold and dropped:
            raise QueryError(f"This query would drop {dropped / total:.2%} of the {what} in the database. Add 'set ignore_threshold true' to the query statement if you really want to do this.")

    def _drop_series(self, stmt: ast.Change) -> str:
        gone = self._noted(self.catalog(stmt.match or ast.All(), stmt.where).select(F.col("name").alias("series")))
        n, total = gone.count(), self.points().select("series").distinct().count()
        self._guard(n, total, stmt.values["ignore"], "series")
        if n:
            self._remove(lambda p: p.join(gone, "series", "left_semi"), lambda p: p.join(gone, "series", "left_anti"))
        return f"Successfully dropped {n} series."

    def _drop_shards(self, stmt: ast.Change) -> str:
        total = self.entity("shards").count()
        path = folder(self.spark, "shards")
        self.entity("shards", where=stmt.where).select(F.col("pool").alias("_pool"), F.col("type").alias("_type"), F.col("start").alias("_start")).write.parquet(path)
        gone = self.spark.read.schema("_pool int, _type string, _start long").parquet(path)
        n = gone.count()
        self._guard(n, total, stmt.values["ignore"], "shards")

        def joined(points: DataFrame, how: str) -> DataFrame:
            log = F.col("tp") == "string"
            width = F.when(log, F.lit(self.options.duration_log * self.factor)).otherwise(F.lit(self.options.duration_num * self.factor))
            rows = points.withColumns({"_pool": pool_of(F.col("series"), self.options.pools).cast("int"), "_type": F.when(log, F.lit("log")).otherwise(F.lit("number")), "_start": F.col("ts") - F.pmod(F.col("ts"), width)})
            return rows.join(gone, ["_pool", "_type", "_start"], how).select(*points.columns)

        if n:
            self._remove(lambda p: joined(p, "left_semi"), lambda p: joined(p, "left_anti"))
        return f"Successfully dropped {n} shards."

    def _alter_database(self, stmt: ast.Change) -> str:
        prop, value = stmt.values["prop"], stmt.values["value"]
        old = self.property(prop)
        if prop == "drop_threshold" and not 0 <= value <= 1:
            raise QueryError("Drop threshold should be a value between or equal to 0 and 1.0.")
        if prop == "list_limit" and value < 1000:
            raise QueryError("List limit should be a value greater than or equal to 1000.")
        if prop == "select_points_limit" and value < 1:
            raise QueryError("Select points limit should be a value greater than 0.")
        if prop == "tee" and value is not None:
            parsed(value)
        if prop == "timezone":
            zone(value)
            if value == self.options.timezone:
                raise QueryError(f"Database '{self.options.dbname}' is already set to time-zone '{value}'.")
        self.options = replace(self.options, **{prop: value})
        if prop.startswith("expiration"):
            before = self.entity("shards").count()
            after = shard_catalog(self._unexpired(self.points()), self.options, self.factor).count()
            try:
                self._guard(before - after, before, stmt.values["ignore"], "shards")
            except QueryError:
                self.options = replace(self.options, **{prop: old})
                raise
            if after < before:
                self._remove(lambda p: p.where(self._old()), self._unexpired)
        if prop == "tee":
            return "Successfully disabled tee." if value is None else f"Successfully configured tee to {value}."
        return f"Successfully changed {prop.replace('_', ' ') if prop != 'drop_threshold' else prop} from {old} to {value}."

    def _create_user(self, stmt: ast.Change) -> str:
        if len(stmt.name) < 2:
            raise QueryError("User name should be at least 2 characters.")
        if stmt.name in self.users.rows:
            raise QueryError(f"User '{stmt.name}' already exists.")
        self.users.rows[stmt.name] = (0, Users.digest(stmt.name, _password(stmt.values["password"])))
        return f"Successfully created user '{stmt.name}'."

    def _need_user(self, name: str) -> tuple[int, str]:
        if name not in self.users.rows:
            raise QueryError(f"Cannot find user: '{name}'")
        return self.users.rows[name]

    def _drop_user(self, stmt: ast.Change) -> str:
        self._need_user(stmt.name)
        del self.users.rows[stmt.name]
        return f"Successfully dropped user '{stmt.name}'."

    def _alter_user(self, stmt: ast.Change) -> str:
        access, secret = self._need_user(stmt.name)
        if "password" in stmt.values:
            self.users.rows[stmt.name] = (access, Users.digest(stmt.name, _password(stmt.values["password"])))
        else:
            new = stmt.values["name"]
            if new in self.users.rows:
                raise QueryError(f"User '{new}' already exists.")
            del self.users.rows[stmt.name]
            self.users.rows[new] = (access, secret)
        return f"Successfully updated user '{stmt.name}'."

    def _grant_user(self, stmt: ast.Change) -> str:
        secret = stmt.values["password"]
        if stmt.name not in self.users.rows and secret is None:
            raise QueryError(f"Cannot find user: '{stmt.name}'")
        access, old = self.users.rows.get(stmt.name, (0, ""))
        self.users.rows[stmt.name] = (access | bits(stmt.values["access"]), old if secret is None else Users.digest(stmt.name, _password(secret)))
        return f"Successfully granted permissions to user '{stmt.name}'."

    def _revoke_user(self, stmt: ast.Change) -> str:
        access, secret = self._need_user(stmt.name)
        self.users.rows[stmt.name] = (access & ~bits(stmt.values["access"]), secret)
        return f"Successfully revoked permissions from user '{stmt.name}'."

    def _alter_servers(self, stmt: ast.Change) -> str:
        self.options = replace(self.options, log_level=stmt.values["log_level"])
        return f"Successfully set log level to '{stmt.values['log_level']}' on 1 servers."

    def _alter_server(self, stmt: ast.Change) -> str:
        if "log_level" in stmt.values:
            return self._alter_servers(stmt)
        raise QueryError("The cluster is Spark's; its servers are not altered here.")

    def _drop_server(self, stmt: ast.Change) -> str:
        raise QueryError(f"Cannot remove server '{stmt.name}' because the cluster is Spark's.")

    # fluent

    def series(self, match: str = "*") -> Query:
        """A query built by calls: engine.series("/cpu.*/").after(t).mean("1h").difference().frame()."""
        return Query(self, match)


class Query:
    """Calls that add up to a statement's text, so that both ways share one compiler."""

    def __init__(self, engine: Engine, match: str, chain: tuple[str, ...] = (), where: str = "", span: str = "", merge: str = "") -> None:
        self._engine, self._match, self._chain, self._where, self._span, self._merge = engine, match, chain, where, span, merge

    def _with(self, **changes: Any) -> Query:
        own = {"match": self._match, "chain": self._chain, "where": self._where, "span": self._span, "merge": self._merge}
        return Query(self._engine, **{**own, **changes})

    def where(self, text: str) -> Query:
        return self._with(where=f" where {text}")

    def after(self, t: Any) -> Query:
        return self._with(span=f" after {_time(t)}")

    def before(self, t: Any) -> Query:
        return self._with(span=f" before {_time(t)}")

    def between(self, a: Any, b: Any) -> Query:
        return self._with(span=f" between {_time(a)} and {_time(b)}")

    def head(self, n: int) -> Query:
        return self._with(span=f" head {n}")

    def tail(self, n: int) -> Query:
        return self._with(span=f" tail {n}")

    def merge(self, name: str, using: str = "") -> Query:
        return self._with(merge=f' merge as "{name}"' + (f" using {using}" if using else ""))

    def filter(self, text: str) -> Query:
        return self._with(chain=(*self._chain, f"filter({text})"))

    def __getattr__(self, name: str) -> Callable[..., Query]:
        if name.startswith("_"):
            raise AttributeError(name)
        return lambda *args: self._with(chain=(*self._chain, f"{name}({', '.join(map(str, args))})"))

    def text(self) -> str:
        return f"select {' => '.join(self._chain) or '*'} from {self._match}{self._where}{self._span}{self._merge}"

    def frame(self) -> DataFrame:
        return self._engine.query(self.text())

    def collect(self) -> dict:
        return self._engine.run(self.text())


def _time(t: Any) -> str:
    return str(t) if isinstance(t, int) or t == "now" or str(t).startswith(("now", "'", '"', "(")) else f'"{t}"'


def _named(name: str, what: str) -> str:
    if not name:
        raise QueryError(f"{what} name should be at least 1 characters.")
    if len(name) > NAME_LENGTH:
        raise QueryError(f"{what} name should be at most {NAME_LENGTH} characters.")
    return name


def _password(text: str) -> str:
    if len(text) < 4:
        raise QueryError("Password should be at least 4 characters.")
    return text


def _access_bits(where: Any) -> Any:
    if isinstance(where, ast.Logic):
        return ast.Logic(where.op, _access_bits(where.left), _access_bits(where.right))
    return ast.Compare(where.prop, where.op, bits(where.value)) if where.prop == "access" else where


def _scaled(frame: DataFrame, scale: float) -> DataFrame:
    """Times in another precision."""
    if scale == 1:
        return frame
    ts = F.col("ts") * F.lit(int(scale)) if scale > 1 else (F.col("ts") - F.pmod(F.col("ts"), F.lit(round(1 / scale)))) / F.lit(round(1 / scale))
    return frame.withColumn("ts", ts.cast("long"))


def _message(e: PySparkException) -> str:
    """The text that raise_error was given, or Spark's own."""
    text = str(e)
    if "USER_RAISED_EXCEPTION" in text:
        return text.split("[USER_RAISED_EXCEPTION]", 1)[1].split("SQLSTATE", 1)[0].strip()
    return text.split("\n", 1)[0]
