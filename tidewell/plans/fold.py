"""Constants of the language, folded on the driver: integer and time expressions and dates."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError, available_timezones

from tidewell.errors import QueryError

PRECISIONS = {"s": 1, "ms": 1000, "us": 1_000_000, "ns": 1_000_000_000}
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
LONGEST = 512


def zone(name: str) -> ZoneInfo | timezone:
    """A time zone by name, in any case; NAIVE is UTC."""
    if name.upper() == "NAIVE":
        return timezone.utc
    try:
        return ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError, OSError):
        pass
    known = {z.lower(): z for z in available_timezones()}
    if name.lower() not in known:
        raise QueryError(f"Unknown time-zone: '{name}'")
    return ZoneInfo(known[name.lower()])


DATE = re.compile(
    r"(?P<year>\d{4})(?:-(?P<month>\d{1,2})(?:-(?P<day>\d{1,2})(?:[T ](?P<hour>\d{1,2})(?::(?P<minute>\d{1,2})(?::(?P<second>\d{1,2}))?)?)?)?)?"
    r"(?P<off>Z|[+-]\d{1,2}(?::?\d{2})?)?"
)


def date_seconds(text: str, tz: ZoneInfo | timezone) -> int:
    """Unix seconds of a date: year, then month, day, hour, minute and second as far as given, then perhaps Z or an offset."""
    m = DATE.fullmatch(text.strip())
    if not m or (m["off"] or "").startswith("-") and not m["day"]:
        raise QueryError(f"Cannot convert '{text}' to a timestamp")
    parts = [int(m[k] or d) for k, d in (("year", 1970), ("month", 1), ("day", 1), ("hour", 0), ("minute", 0), ("second", 0))]
    off = m["off"]
    if off == "Z":
        tz = timezone.utc
    elif off:
        digits = off[1:].replace(":", "")
        hours, minutes = (digits, "0") if len(digits) <= 2 else (digits[:-2], digits[-2:])
        delta = timedelta(hours=int(hours), minutes=int(minutes))
        tz = timezone(-delta if off[0] == "-" else delta)
    try:
        return int(datetime(*parts, tzinfo=tz).timestamp())
    except ValueError as e:
        raise QueryError(f"Cannot convert '{text}' to a timestamp") from e


def whole_div(a: int, b: int) -> int:
    """Division that cuts toward zero."""
    if not b:
        raise QueryError("Division by zero error.")
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


def whole_mod(a: int, b: int) -> int:
    if not b:
        raise QueryError("Modulo by zero error.")
    return a - whole_div(a, b) * b


@dataclass
class Clock:
    """What time expressions are folded with; now is one instant for a whole statement."""

    precision: str = "ms"
    tz: ZoneInfo | timezone = timezone.utc
    now_ns: int = field(default_factory=time.time_ns)

    @property
    def factor(self) -> int:
        return PRECISIONS[self.precision]

    @property
    def now(self) -> int:
        return self.now_ns // (1_000_000_000 // self.factor)

    def duration(self, text: str) -> int:
        return int(text[:-1]) * SECONDS[text[-1]] * self.factor

    def date(self, text: str) -> int:
        return date_seconds(text, self.tz) * self.factor


TOKEN = re.compile(r"\s*(?:(?P<duration>\d+[smhdw](?![a-z0-9]))|(?P<number>\d+)|(?P<now>now)\b|(?P<text>'(?:[^']*)'|\"(?:[^\"]*)\")|(?P<op>[-+*/%()]))")


class Folder:
    """A recursive descent over one expression in a longer text; stops where it ends."""

    def __init__(self, text: str, at: int, clock: Clock, times: bool) -> None:
        self.text, self.at, self.clock, self.times, self.begin = text, at, clock, times, at

    def peek(self) -> re.Match | None:
        m = TOKEN.match(self.text, self.at)
        if m and not self.times and m.lastgroup in ("duration", "now", "text"):
            return None
        return m

    def fold(self) -> tuple[int, int]:
        value = self.sum()
        if self.at - self.begin > LONGEST:
            raise QueryError("Expression too long.")
        return value, self.at

    def sum(self) -> int:
        value = self.product()
        while (m := self.peek()) and m["op"] and m["op"] in "+-":
            self.at = m.end()
            other = self.product()
            value = value + other if m["op"] == "+" else value - other
        return value

    def product(self) -> int:
        value = self.unit()
        while (m := self.peek()) and m["op"] and m["op"] in "*/%":
            self.at = m.end()
            other = self.unit()
            value = value * other if m["op"] == "*" else whole_div(value, other) if m["op"] == "/" else whole_mod(value, other)
        return value

    def unit(self) -> int:
        m = self.peek()
        if not m:
            raise QueryError(f"Query error at position {self.at}. Expecting an expression")
        self.at = m.end()
        if m["number"]:
            return int(m["number"])
        if m["duration"]:
            return self.clock.duration(m["duration"])
        if m["now"]:
            return self.clock.now
        if m["text"]:
            return self.clock.date(m["text"][1:-1])
        if m["op"] == "(":
            value = self.sum()
            end = self.peek()
            if not end or end["op"] != ")":
                raise QueryError(f"Query error at position {self.at}. Expecting )")
            self.at = end.end()
            return value
        if m["op"] in "+-":
            value = self.unit()
            return -value if m["op"] == "-" else value
        raise QueryError(f"Query error at position {m.start()}. Expecting an expression")


def fold(text: str, clock: Clock | None = None) -> int:
    """The value of a whole expression."""
    value, end = Folder(text, 0, clock or Clock("s"), True).fold()
    if text[end:].strip():
        raise QueryError(f"Query error at position {end}.")
    return value
