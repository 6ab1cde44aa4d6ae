"""What is known besides points: series metadata, groups, tags, users, pools, shards and the database's options."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.errors import QueryError
from tidewell.plans.ast import Regex

SLOTS = 8192
ACCESS = {n: 1 << i for i, n in enumerate(("show", "count", "list", "select", "insert", "create", "alter", "drop", "grant", "revoke"))}
ACCESS["read"] = sum(ACCESS[n] for n in ("show", "count", "list", "select"))
ACCESS["write"] = ACCESS["read"] | ACCESS["insert"]
ACCESS["modify"] = ACCESS["write"] | ACCESS["create"] | ACCESS["alter"] | ACCESS["drop"]
ACCESS["full"] = ACCESS["modify"] | ACCESS["grant"] | ACCESS["revoke"]


@dataclass
class Options:
    dbname: str = "tidewell"
    time_precision: str = "ms"
    timezone: str = "NAIVE"
    drop_threshold: float = 1.0
    list_limit: int = 10_000
    select_points_limit: int | None = 1_000_000
    duration_num: int = 604_800
    duration_log: int = 86_400
    expiration_num: int = 0
    expiration_log: int = 0
    tee: str | None = None
    pools: int = 1
    log_level: str = "warning"
    uuid: str = field(default_factory=lambda: str(uuid.uuid4()))


@dataclass
class Users:
    """name -> access bits and a salted digest of the password."""

    rows: dict[str, tuple[int, str]] = field(default_factory=lambda: {"admin": (ACCESS["full"], "")})

    @staticmethod
    def digest(name: str, password: str) -> str:
        return hashlib.scrypt(password.encode(), salt=name.encode(), n=1 << 12, r=8, p=1).hex()

    def checked(self, name: str, password: str) -> bool:
        return name in self.rows and self.rows[name][1] == self.digest(name, password)


def bits(names: list[str] | tuple[str, ...]) -> int:
    out = 0
    for n in names:
        out |= ACCESS[n]
    return out


def access_text(value: int) -> str:
    """The profiles and names that make up the bits."""
    if not value:
        return "no access"
    for profile in ("full", "modify", "write", "read"):
        if value & ACCESS[profile] == ACCESS[profile]:
            rest = [n for n, b in ACCESS.items() if n not in ("full", "modify", "write", "read") and b & value & ~ACCESS[profile]]
            return " and ".join([", ".join([profile, *rest[:-1]]), rest[-1]]) if rest else profile
    names = [n for n, b in ACCESS.items() if n not in ("full", "modify", "write", "read") and b & value]
    return " and ".join([", ".join(names[:-1]), names[-1]]) if len(names) > 1 else names[0]


def lookup(pools: int) -> list[int]:
    """The pool of each slot, built up pool by pool: each new one takes every k-th slot of those before it, staggered."""
    slots = [0] * SLOTS
    for new in range(1, pools):
        seen = list(range(new))
        for i, owner in enumerate(slots):
            seen[owner] += 1
            if seen[owner] % (new + 1) == 0:
                slots[i] = new
    return slots


def pool_of(name: Column, pools: int) -> Column:
    """The pool of a name: the sum of its bytes, as signed, picks a slot."""
    if pools <= 1:
        return F.lit(0)
    raw = F.encode(name, "UTF-8")
    bytes_ = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(name), F.lit(1))), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long"))
    total = F.aggregate(bytes_, F.lit(0).cast("long"), lambda s, b: s + F.when(b > 127, b - 256).otherwise(F.coalesce(b, F.lit(0))))
    # as an unsigned 32-bit sum, of which 8192 is a divisor
    return F.get(F.array(*[F.lit(x) for x in lookup(pools)]), F.pmod(total, F.lit(SLOTS)).cast("int"))


def series_catalog(points: DataFrame, options: Options, factor: int) -> DataFrame:
    """name, type, length, start, end, pool, shard_duration of every series."""
    df = points.groupBy("series").agg(F.min("tp").alias("type"), F.count(F.lit(1)).alias("length"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    log = F.col("type") == "string"
    return df.select(F.col("series").alias("name"), "type", "length", "start", "end", pool_of(F.col("series"), options.pools).cast("int").alias("pool"), F.when(log, F.lit(options.duration_log * factor)).otherwise(F.lit(options.duration_num * factor)).cast("long").alias("shard_duration"))


def shard_catalog(points: DataFrame, options: Options, factor: int) -> DataFrame:
    """The slices that the points fall in; size is 16 bytes a number and 8 besides the text a string."""
    log = F.col("tp") == "string"
    width = F.when(log, F.lit(options.duration_log * factor)).otherwise(F.lit(options.duration_num * factor)).cast("long")
    df = points.withColumn("width", width).withColumn("start", F.col("ts") - F.pmod(F.col("ts"), F.col("width")))
    df = df.withColumn("type", F.when(log, F.lit("log")).otherwise(F.lit("number"))).withColumn("pool", pool_of(F.col("series"), options.pools).cast("int"))
    size = F.sum(F.when(log, F.octet_length("vs") + 8).otherwise(F.lit(16))).cast("long")
    df = df.groupBy("pool", "type", "start", "width").agg(size.alias("size"))
    sid = F.col("start") + F.when(F.col("type") == "log", F.lit(1)).otherwise(F.lit(0))
    return df.select(sid.alias("sid"), "pool", F.lit(options.dbname).alias("server"), "size", "start", (F.col("start") + F.col("width")).alias("end"), "type", F.lit("ok").alias("status"))


@dataclass
class Names:
    """Groups and tags; a group is a regular expression, a tag a table of names (series)."""

    groups: dict[str, Regex] = field(default_factory=dict)
    tags: dict[str, DataFrame] = field(default_factory=dict)

    def need_group(self, name: str) -> Regex:
        if name not in self.groups:
            raise QueryError(f"Group '{name}' does not exist.")
        return self.groups[name]

    def need_tag(self, name: str) -> DataFrame:
        if name not in self.tags:
            raise QueryError(f"Tag '{name}' does not exist.")
        return self.tags[name]
