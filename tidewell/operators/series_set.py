"""Series selection: set algebra over names as one predicate, which reaches the scan; of tags it tests marks that joins have made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.errors import QueryError
from tidewell.plans import ast


def anchored(regex: ast.Regex) -> str:
    """The text with ^ in front and $ behind, no group added: /a|b/ is ^a|b$."""
    return f"{'(?i)' if regex.ignore_case else ''}^{regex.text}$"


def predicate(match, name: Column, look_up: Callable[[str], Callable[[Column], Column]]) -> Column:
    """Whether a name is in the set. look_up gives the predicate of a group or tag."""
    if isinstance(match, ast.All):
        return F.lit(True)
    if isinstance(match, ast.Name):
        return name == match.name
    if isinstance(match, ast.Regex):
        return name.rlike(anchored(match))
    if isinstance(match, ast.Ref):
        return look_up(match.name)(name)
    if (names := _names(match)) is not None:
        return name.isin(*names)
    # a long chain from left to right, without recursion on its left side; runs of unions become a flat tree
    rest = []
    while isinstance(match, ast.SetOp) and _names(match) is None:
        rest.append((match.op, match.right))
        match = match.left
    parts = [predicate(match, name, look_up)]
    for op, right in reversed(rest):
        other = predicate(right, name, look_up)
        if op == "union":
            parts.append(other)
            continue
        out = _any(parts)
        if op == "intersection":
            parts = [out & other]
        elif op == "difference":
            parts = [out & ~other]
        else:
            parts = [(out & ~other) | (~out & other)]
    return _any(parts)


def _any(parts: list[Column]) -> Column:
    while len(parts) > 1:
        parts = [parts[k] | parts[k + 1] if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def _names(match) -> list[str] | None:
    """The names of a union of names alone."""
    found = []
    while isinstance(match, ast.SetOp) and match.op == "union" and isinstance(match.right, ast.Name):
        found.append(match.right.name)
        match = match.left
    if not isinstance(match, ast.Name):
        return None
    return sorted({match.name, *found})


def names_in(match) -> set[str]:
    """The names that the set states."""
    out, todo = set(), [match]
    while todo:
        at = todo.pop()
        if isinstance(at, ast.Name):
            out.add(at.name)
        elif isinstance(at, ast.SetOp):
            todo += [at.left, at.right]
    return out


def refs_in(match) -> set[str]:
    """The groups and tags that the set states."""
    out, todo = set(), [match]
    while todo:
        at = todo.pop()
        if isinstance(at, ast.Ref):
            out.add(at.name)
        elif isinstance(at, ast.SetOp):
            todo += [at.left, at.right]
    return out


TEXT_OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "~": lambda a, b: a.contains(b), "!~": lambda a, b: ~a.contains(b)}


def condition(where, prop: Callable[[str], Column]) -> Column:
    """A where clause as a column."""
    if isinstance(where, ast.Logic):
        left, right = condition(where.left, prop), condition(where.right, prop)
        return left & right if where.op == "and" else left | right
    if not isinstance(where, ast.Compare):
        raise QueryError("Cannot use this condition")
    return TEXT_OPS[where.op](prop(where.prop), where.value)


def props_in(where) -> set[str]:
    if isinstance(where, ast.Logic):
        return props_in(where.left) | props_in(where.right)
    return {where.prop} if where is not None else set()
