"""Recursive descent from a statement's text to the tree of plans/ast.py."""

from __future__ import annotations

import re
import sys

from tidewell.errors import QueryError
from tidewell.plans import ast
from tidewell.plans.fold import Clock, Folder

NUMBER = r"[-+]?\d*\.?\d+"
LONGEST, DEEPEST, WHERE_DEEPEST = 65535, 500, 5
MOST_POINTS = 1_000_000
GROUPED = ("count", "sum", "mean", "median", "median_low", "median_high", "min", "max", "variance", "pvariance", "stddev", "first", "last")
SET_OPS = {",": "union", "|": "union", "union": "union", "&": "intersection", "intersection": "intersection", "-": "difference", "difference": "difference", "^": "symmetric_difference", "symmetric_difference": "symmetric_difference"}
COLUMNS = {
    "series": ("name", "type", "length", "start", "end", "shard_duration", "pool"),
    "shards": ("sid", "pool", "server", "size", "start", "end", "type", "status"),
    "groups": ("expression", "name", "series"),
    "tags": ("name", "series"),
    "pools": ("pool", "servers", "series"),
    "users": ("name", "access"),
    "servers": tuple(
        """name pool version online status address buffer_path buffer_size dbpath ip_support libuv port uuid startup_time active_handles active_tasks
        fifo_files idle_percentage idle_time log_level max_open_files mem_usage open_files received_points reindex_progress selected_points sync_progress uptime""".split()
    ),
}
TEXT_PROPS = {"name", "expression", "server", "status", "address", "buffer_path", "dbpath", "ip_support", "libuv", "uuid", "version", "reindex_progress", "sync_progress"}
WORD_PROPS = {"type": ("string", "integer", "float", "number", "log"), "online": ("true", "false"), "log_level": tuple("debug info warning error critical".split()), "access": None}
TIME_PROPS = {"start", "end", "shard_duration"}
ACCESS = ("show", "count", "list", "select", "insert", "create", "alter", "drop", "grant", "revoke", "read", "write", "modify", "full")
SHOWN = (
    "active_handles", "active_tasks", "buffer_path", "buffer_size", "dbname", "dbpath", "drop_threshold", "duration_log", "duration_num", "fifo_files", "expiration_log", "expiration_num", "idle_percentage",
    "idle_time", "ip_support", "libuv", "list_limit", "log_level", "max_open_files", "mem_usage", "open_files", "pool", "received_points", "reindex_progress", "selected_points", "select_points_limit",
    "server", "startup_time", "status", "sync_progress", "tee", "time_precision", "timezone", "uptime", "uuid", "version", "who_am_i",
)


def parse(text: str, clock: Clock | None = None) -> ast.Statement:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * DEEPEST))
    return Parser(text, clock or Clock()).statement()


class Parser:
    def __init__(self, text: str, clock: Clock) -> None:
        if len(text.encode()) > LONGEST:
            raise QueryError("Query too long.")
        self.text, self.clock, self.at, self.depth = text, clock, 0, 0

    # scanning

    def space(self) -> None:
        self.at = re.compile(r"\s*").match(self.text, self.at).end()

    def fail(self, expecting: str) -> QueryError:
        self.space()
        return QueryError(f"Query error at position {self.at}. Expecting {expecting}")

    def scan(self, pattern: str) -> str | None:
        self.space()
        m = re.compile(pattern).match(self.text, self.at)
        if not m:
            return None
        self.at = m.end()
        return m[0]

    def word(self, *words: str) -> str | None:
        self.space()
        m = re.compile(r"[a-z_]+").match(self.text, self.at)
        if m and m[0] in words:
            self.at = m.end()
            return m[0]
        return None

    def need(self, *words: str) -> str:
        found = self.word(*words)
        if found is None:
            raise self.fail(", ".join(words))
        return found

    def mark(self, sign: str) -> bool:
        self.space()
        if self.text.startswith(sign, self.at):
            self.at += len(sign)
            return True
        return False

    def need_mark(self, sign: str) -> None:
        if not self.mark(sign):
            raise self.fail(sign)

    def string(self) -> str | None:
        for q in "'\"":
            found = self.scan(f"(?:{q}[^{q}]*{q})+")
            if found is not None:
                return found[1:-1].replace(q + q, q)
        return None

    def need_string(self) -> str:
        found = self.string()
        if found is None:
            raise self.fail("single_quote_str or double_quote_str")
        return found

    def grave(self) -> str:
        found = self.scan("(?:`[^`]*`)+")
        if found is None:
            raise self.fail("grave_str")
        return found[1:-1].replace("``", "`")

    def regex(self) -> ast.Regex | None:
        found = self.scan(r"/[^/\\]*(?:\\.[^/\\]*)*/i?")
        if found is None:
            return None
        ignore = found.endswith("i")
        text = found[1:-2] if ignore else found[1:-1]
        try:
            re.compile(text)
        except re.error as e:
            raise QueryError(f"Cannot compile regular expression '{found}': {e}") from e
        return ast.Regex(text, ignore)

    def number(self, times: bool = False) -> int:
        self.space()
        value, self.at = Folder(self.text, self.at, self.clock, times).fold()
        return value

    # statements

    def statement(self) -> ast.Statement:
        timed = bool(self.word("timeit"))
        body = self.body()
        self.scan("#.*")
        self.space()
        if self.at < len(self.text):
            raise self.fail("end_of_statement")
        return ast.Statement(body, timed)

    def body(self):
        self.space()
        if self.at == len(self.text) or self.text[self.at] == "#":
            return None
        if self.mark("?"):
            return ast.Help(self.topic())
        for verb in ("select", "list", "count", "alter", "create", "drop", "grant", "revoke", "show", "help"):
            if self.word(verb):
                return getattr(self, verb)()
        return ast.Calc(self.number(True))

    def help(self) -> ast.Help:
        return ast.Help(self.topic())

    def topic(self) -> str:
        return (self.scan(r"[a-z_ ]*") or "").strip().replace(" ", "_")

    def select(self) -> ast.Select:
        items = [self.item()]
        while self.mark(","):
            items.append(self.item())
        names = [(i.prefix, i.suffix) for i in items]
        if len(set(names)) < len(names):
            raise QueryError("When using multiple select methods, each must have its own prefix and/or suffix.")
        self.need("from")
        match, where = self.match(), self.where("series")
        span = self.span()
        merge = None
        if self.word("merge"):
            self.need("as")
            name = self.need_string()
            if not name:
                raise QueryError("Error while merging points. Make sure the destination series name is valid.")
            merge = ast.Merge(name, self.chain() if self.word("using") else ())
        return ast.Select(tuple(items), match, where, span, merge)

    def item(self) -> ast.Item:
        chain = self.chain()
        prefix = self.need_string() if self.word("prefix") else ""
        return ast.Item(chain, prefix, self.need_string() if self.word("suffix") else "")

    def chain(self) -> tuple[ast.Func, ...]:
        steps = [self.func()]
        while self.mark("=>"):
            step = self.func()
            if step.name == "offset":
                last = steps[-1]
                if last.name not in (*GROUPED, "difference", "derivative") or not _grouped(last):
                    raise QueryError("Offset must be used after an aggregation method.")
                g = last.args[-1]
                steps[-1] = ast.Func(last.name, last.args, step.args[0] % g)
            else:
                steps.append(step)
        if steps[0].name == "offset":
            raise QueryError("Offset must be used after an aggregation method.")
        return tuple(steps)

    def func(self) -> ast.Func:
        if self.mark("*") or self.word("all", "points"):
            return ast.Func("all")
        name = self.need(*GROUPED, "difference", "derivative", "offset", "timeval", "interval", "filter", "limit")
        self.need_mark("(")
        if name == "filter":
            out = self.filter()
        elif name == "limit":
            n = self.number()
            if n <= 0:
                raise QueryError("Limit must be an integer value larger than zero.")
            self.need_mark(",")
            out = ast.Func("limit", (n, self.need(*GROUPED)))
        else:
            args = []
            if name not in ("timeval", "interval") and not re.compile(r"\s*\)").match(self.text, self.at):
                args.append(self.number(True))
                if name == "derivative" and self.mark(","):
                    args.append(self.number(True))
            if name == "offset" and not args:
                raise self.fail("an expression")
            if name == "derivative" and args and args[0] <= 0:
                raise QueryError("Time-span must be an integer value larger than zero.")
            grouped = args[1:] if name == "derivative" else args if name != "offset" else []
            if any(g <= 0 for g in grouped):
                raise QueryError("Group by time must be an integer value larger than zero.")
            out = ast.Func(name, tuple(args))
        self.need_mark(")")
        return out

    def filter(self) -> ast.Func:
        op = self.scan("==|!=|<=|>=|!~|<|>|~") or "=="
        text = self.string()
        if text is not None:
            return ast.Func("filter", (op, "string", text))
        self.space()
        if self.text.startswith("/", self.at):
            regex = self.regex()
            if regex is None:
                raise self.fail("a regular expression")
            if op not in ("==", "!="):
                raise QueryError("Regular expressions can only be used with 'equal' (==) and 'not equal' (!=) operators.")
            return ast.Func("filter", (op, "regex", regex))
        if op in ("~", "!~"):
            raise QueryError(f"Operator '{op}' can only be used with strings.")
        if self.word("nan"):
            return ast.Func("filter", (op, "float", float("nan")))
        if found := self.scan(r"-?\s*inf\b"):
            return ast.Func("filter", (op, "float", float("-inf") if found[0] == "-" else float("inf")))
        found = self.scan(NUMBER)
        if found is None:
            raise self.fail("a value")
        return ast.Func("filter", (op, "integer", int(found)) if "." not in found else (op, "float", float(found)))

    def span(self) -> ast.Span | None:
        kind = self.word("after", "before", "between", "head", "tail")
        if kind in ("head", "tail"):
            n = self.number()
            if not 1 <= n <= MOST_POINTS:
                raise QueryError(f"{kind.capitalize()} must be a value between 1 and {MOST_POINTS}, got {n}")
            return ast.Span(kind, n)
        if kind is None:
            return None
        first, second = self.number(True), None
        if kind == "between":
            self.need("and")
            second = self.number(True)
            if first > second:
                raise QueryError(f"Start time ({first}) should not be greater than end time ({second}).")
        return ast.Span(kind, first, second)

    # series

    def match(self):
        left = self.operand()
        while op := self.set_op():
            left = ast.SetOp(op, left, self.operand())
        return left

    def set_op(self) -> str | None:
        self.space()
        found = self.text[self.at : self.at + 1]
        if found and found in ",|&-^":
            self.at += 1
            return SET_OPS[found]
        found = self.word("union", "intersection", "difference", "symmetric_difference")
        return SET_OPS[found] if found else None

    def operand(self):
        if self.mark("("):
            self.depth += 1
            if self.depth >= DEEPEST:
                raise QueryError("Memory allocation error or maximum recursion depth reached.")
            inner = self.match()
            self.need_mark(")")
            self.depth -= 1
            return inner
        if self.mark("*") or self.word("all"):
            return ast.All()
        text = self.string()
        if text is not None:
            return ast.Name(text)
        self.space()
        if self.text.startswith("`", self.at):
            return ast.Ref(self.grave())
        regex = self.regex()
        if regex is None:
            raise self.fail("*, all, single_quote_str, double_quote_str or (")
        return regex

    def has_match(self) -> bool:
        self.space()
        return bool(re.compile(r"[*('\"`/]|all\b").match(self.text, self.at))

    # conditions

    def where(self, entity: str):
        if not self.word("where"):
            return None
        return self.either(entity, 0)

    def either(self, entity: str, depth: int):
        left = self.both(entity, depth)
        while self.word("or"):
            left = ast.Logic("or", left, self.both(entity, depth))
        return left

    def both(self, entity: str, depth: int):
        left = self.condition(entity, depth)
        while self.word("and"):
            left = ast.Logic("and", left, self.condition(entity, depth))
        return left

    def condition(self, entity: str, depth: int):
        if self.mark("("):
            if depth >= WHERE_DEEPEST:
                raise QueryError("Max depth reached in 'where' expression!")
            inner = self.either(entity, depth + 1)
            self.need_mark(")")
            return inner
        prop = self.need(*COLUMNS[entity])
        if prop in WORD_PROPS:
            ops = "==|!=" if prop in ("type", "online") else "==|!=|<=|>=|<|>"
            op = self.scan(ops) or self.fail_op(ops)
            if prop == "access":
                return ast.Compare(prop, op, tuple(self.access()))
            found = self.need(*WORD_PROPS[prop])
            return ast.Compare(prop, op, found == "true" if prop == "online" else found)
        if prop in TEXT_PROPS:
            op = self.scan("==|!=|<=|>=|!~|<|>|~") or self.fail_op("==")
            return ast.Compare(prop, op, self.need_string())
        op = self.scan("==|!=|<=|>=|<|>") or self.fail_op("==")
        return ast.Compare(prop, op, self.number(prop in TIME_PROPS))

    def fail_op(self, ops: str):
        raise self.fail(ops.replace("|", ", "))

    # lists and counts

    def list(self) -> ast.Listing:
        entity = self.need(*COLUMNS)
        columns = []
        if found := self.word(*COLUMNS[entity]):
            columns.append(found)
            while self.mark(","):
                columns.append(self.need(*COLUMNS[entity]))
        match = self.match() if entity == "series" and self.has_match() else None
        where = self.where(entity)
        limit = self.number() if self.word("limit") else None
        return ast.Listing(entity, tuple(columns), match, where, limit)

    def count(self) -> ast.Count:
        entity = self.need(*COLUMNS)
        what = self.word(*{"series": ("length",), "shards": ("size",), "servers": ("received_points", "selected_points")}.get(entity, ())) or ""
        match = self.match() if entity == "series" and self.has_match() else None
        return ast.Count(entity, what, match, self.where(entity))

    def show(self) -> ast.Show:
        props = []
        if found := self.word(*SHOWN):
            props.append(found)
            while self.mark(","):
                props.append(self.need(*SHOWN))
        return ast.Show(tuple(props))

    # changes

    def ignoring(self) -> bool:
        if not self.word("set"):
            return False
        self.need("ignore_threshold")
        return self.need("true", "false") == "true"

    def create(self) -> ast.Change:
        if self.need("group", "user") == "group":
            name = self.grave()
            self.need("for")
            regex = self.regex()
            if regex is None:
                raise self.fail("a regular expression")
            return ast.Change("create", "group", name, values={"expression": regex})
        name = self.need_string()
        self.need("set")
        self.need("password")
        return ast.Change("create", "user", name, values={"password": self.need_string()})

    def drop(self) -> ast.Change:
        entity = self.need("group", "tag", "series", "shards", "server", "user")
        if entity in ("group", "tag"):
            return ast.Change("drop", entity, self.grave())
        if entity in ("user", "server"):
            return ast.Change("drop", entity, self.need_string())
        match = self.match() if entity == "series" and self.has_match() else None
        where = self.where(entity)
        if entity == "series" and match is None and where is None:
            raise self.fail("a series match or where")
        return ast.Change("drop", entity, match=match, where=where, values={"ignore": self.ignoring()})

    def alter(self) -> ast.Change:
        entity = self.need("series", "user", "group", "tag", "servers", "server", "database")
        if entity == "series":
            match = self.match()
            where = self.where("series")
            return ast.Change("alter", "series", match=match, where=where, values={self.need("tag", "untag"): self.grave()})
        if entity == "database":
            self.need("set")
            prop = self.need("drop_threshold", "list_limit", "select_points_limit", "timezone", "expiration_num", "expiration_log", "tee")
            if prop == "timezone":
                value = self.need_string()
            elif prop == "tee":
                value = None if self.word("false") else self.need_string()
            elif prop == "drop_threshold":
                value = float(self.scan(NUMBER) or self.fail_op("a number"))
            elif prop.startswith("expiration"):
                value = self.number(True)
            else:
                value = int(self.scan("[0-9]+") or self.fail_op("a number"))
            return ast.Change("alter", "database", values={"prop": prop, "value": value, "ignore": self.ignoring()})
        if entity == "servers":
            where = self.where("servers")
            self.need("set")
            self.need("log_level")
            return ast.Change("alter", "servers", where=where, values={"log_level": self.need(*WORD_PROPS["log_level"])})
        name = self.grave() if entity in ("group", "tag") else self.need_string()
        self.need("set")
        prop = self.need(*{"group": ("expression", "name"), "tag": ("name",), "user": ("password", "name"), "server": ("log_level", "backup_mode", "address", "port")}[entity])
        if prop == "expression":
            value = self.regex()
            if value is None:
                raise self.fail("a regular expression")
        elif prop in ("log_level", "backup_mode"):
            value = self.need(*(WORD_PROPS["log_level"] if prop == "log_level" else ("true", "false")))
        else:
            value = int(self.scan("[0-9]+") or self.fail_op("a number")) if prop == "port" else self.need_string()
        return ast.Change("alter", entity, name, values={prop: value})

    def access(self) -> list[str]:
        found = [self.need(*ACCESS)]
        while self.mark(","):
            found.append(self.need(*ACCESS))
        return found

    def grant(self) -> ast.Change:
        access = self.access()
        self.need("to")
        self.need("user")
        name, password = self.need_string(), None
        if self.word("set"):
            self.need("password")
            password = self.need_string()
        return ast.Change("grant", "user", name, values={"access": access, "password": password})

    def revoke(self) -> ast.Change:
        access = self.access()
        self.need("from")
        self.need("user")
        return ast.Change("revoke", "user", self.need_string(), values={"access": access})


def _grouped(f: ast.Func) -> bool:
    return len(f.args) == (2 if f.name == "derivative" else 1)
