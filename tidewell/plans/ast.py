"""What the parser makes of a statement."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class All:
    """Every series."""


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Regex:
    text: str
    ignore_case: bool = False


@dataclass(frozen=True)
class Ref:
    """A group or a tag."""

    name: str


@dataclass(frozen=True)
class SetOp:
    op: str  # union, difference, intersection, symmetric_difference
    left: Any
    right: Any


@dataclass(frozen=True)
class Compare:
    prop: str
    op: str
    value: Any


@dataclass(frozen=True)
class Logic:
    op: str  # and, or
    left: Any
    right: Any


@dataclass(frozen=True)
class Func:
    """A step of a chain. args: folded numbers; for filter (op, kind, value); for limit (n, function name)."""

    name: str
    args: tuple = ()
    offset: int = 0


@dataclass(frozen=True)
class Item:
    chain: tuple[Func, ...]
    prefix: str = ""
    suffix: str = ""


@dataclass(frozen=True)
class Span:
    """kind: after, before, between, head or tail."""

    kind: str
    first: int
    second: int | None = None


@dataclass(frozen=True)
class Merge:
    name: str
    using: tuple[Func, ...] = ()


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    match: Any
    where: Any = None
    span: Span | None = None
    merge: Merge | None = None


@dataclass(frozen=True)
class Listing:
    entity: str
    columns: tuple[str, ...] = ()
    match: Any = None
    where: Any = None
    limit: int | None = None


@dataclass(frozen=True)
class Count:
    """what: empty, or length (series), size (shards), received_points or selected_points (servers)."""

    entity: str
    what: str = ""
    match: Any = None
    where: Any = None


@dataclass(frozen=True)
class Show:
    props: tuple[str, ...] = ()


@dataclass(frozen=True)
class Calc:
    value: int


@dataclass(frozen=True)
class Help:
    topic: str = ""


@dataclass(frozen=True)
class Change:
    """A statement with a side effect: verb (create, drop, alter, grant, revoke), entity and what it needs."""

    verb: str
    entity: str
    name: str = ""
    match: Any = None
    where: Any = None
    values: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Statement:
    body: Any
    timed: bool = False
