"""The SQL dialect.

[EXPLAIN] SELECT columns FROM name [WHERE condition] [GROUP BY time(1m | auto) and tags] [FILL(previous)]
[DOWNSAMPLE n [USING method]] [ORDER BY time | value [ASC | DESC]] [LIMIT n] [OFFSET n]

Conditions on time, value and tags join with AND, OR, NOT and parentheses; those on time only with AND at the top.
"""

from __future__ import annotations

import re

from ..functions import durations
from ..functions.aggregates import canonical
from . import ast
from .lexer import Cursor, QueryError

FUNCTIONS = ("count", "sum", "avg", "mean", "min", "max", "stddev", "variance", "median", "first", "last", "rate", "percentile", "increase", "delta", "irate", "idelta", "quantile", "count_distinct", "percentile_approx", "count_distinct_approx")
METHODS = ("lttb", "m4", "average", "avg", "minmax", "first", "last")
FILLS = ("none", "null", "zero", "previous", "linear")
DEFAULT_RANGE_MS = 3_600_000
_CLAUSES = ("group", "fill", "downsample", "order", "limit", "offset")


def parse(text: str, now_ms: int) -> ast.Query:
    """The query; now() and the default range (the last hour) count from now_ms. QueryError if it isn't valid."""
    return _Parser(text, now_ms).query()


class _Parser(Cursor):
    def __init__(self, text: str, now_ms: int):
        super().__init__(text)
        self.now_ms = now_ms
        self.lo: int | None = None
        self.hi: int | None = None

    def query(self) -> ast.Query:
        explain = self.accept("explain")
        self.expect("select")
        columns, calls = self.columns()
        self.expect("from")
        metric = self.identifier()
        where = self.disjunction(True) if self.accept("where") else None
        window, tags = None, ()
        if self.accept("group"):
            self.expect("by")
            window, tags = self.groups()
        fill = self.fill() if self.accept("fill") else ast.Fill()
        method, target = "lttb", 0
        if self.accept("downsample"):
            target = self.whole()
            if target < 1:
                raise QueryError("DOWNSAMPLE needs a positive number")
            if self.accept("using"):
                method = self.expect(*METHODS).text.lower()
        order: list[tuple[str, bool]] = []
        if self.accept("order"):
            self.expect("by")
            while True:
                field = self.identifier()
                down = self.accept("desc")
                if not down:
                    self.accept("asc")
                order.append((field.lower(), down))
                if not self.accept(","):
                    break
        limit = self.whole() if self.accept("limit") else None
        offset = self.whole() if self.accept("offset") else 0
        if self.now.kind != "end":
            self.fail("the end")
        low = [c.lower() for c in columns]
        kind = "aggregate" if calls else "downsample" if target else "latest" if low and low[0] in ("latest", "last") else "select"
        if kind != "aggregate" and (window or tags):
            raise QueryError("GROUP BY needs an aggregate")
        if kind == "latest" and limit is None:
            limit = 1
        hi = self.now_ms if self.hi is None else self.hi
        lo = hi - DEFAULT_RANGE_MS if self.lo is None else self.lo
        if kind == "latest" and self.lo is None:
            lo = 0
        return ast.Query(kind, metric, lo, hi, where, tuple(columns) or ("*",), tuple(calls), window, tags, fill, method, target, tuple(order), limit, offset, explain)

    def columns(self) -> tuple[list[str], list[ast.Call]]:
        names: list[str] = []
        calls: list[ast.Call] = []
        while True:
            if self.accept("*"):
                names.append("*")
            elif self.ahead().text == "(" and self.ahead().kind == "op":
                calls.append(self.call())
            else:
                names.append(self.identifier())
            if not self.accept(","):
                break
        if names and calls:
            raise QueryError("columns and aggregates can't be mixed")
        if len({c.name for c in calls}) < len(calls):
            calls = [ast.Call(c.function, c.arg, c.alias or f"{c.function}_{i + 1}") for i, c in enumerate(calls)]
        return names, calls

    def call(self) -> ast.Call:
        name = self.kind("word").text.lower()
        if canonical(name)[0] not in FUNCTIONS and name not in FUNCTIONS:
            raise QueryError(f"unknown function {name!r}")
        self.expect("(")
        if self.accept("distinct"):
            if name != "count":
                raise QueryError("DISTINCT goes with count")
            name = "count_distinct"
        if not self.accept("*"):
            self.identifier()
        arg = None
        if self.accept(","):
            arg = float(self.kind("number").text)
        self.expect(")")
        if name in ("percentile", "quantile") and arg is None:
            raise QueryError(f"{name} needs a number")
        alias = self.identifier() if self.accept("as") else None
        return ast.Call(name, arg, alias)

    def groups(self) -> tuple[ast.Window | None, tuple[str, ...]]:
        window, tags = None, []
        while True:
            if self.sees("time", "session") and self.ahead().text == "(":
                session = self.take().text.lower() == "session"
                self.expect("(")
                size = 0 if self.accept("auto") else self.duration()
                slide = self.duration() if self.accept(",") else None
                self.expect(")")
                window = ast.Window(size, slide, session)
            else:
                tags.append(self.identifier())
            if not self.accept(","):
                return window, tuple(tags)

    def fill(self) -> ast.Fill:
        self.expect("(")
        if self.now.kind == "number":
            found = ast.Fill("value", float(self.take().text))
        else:
            found = ast.Fill(self.expect(*FILLS).text.lower())
        self.expect(")")
        return found

    # conditions

    def disjunction(self, top: bool) -> ast.Condition | None:
        parts = [self.conjunction(top and not self._or_follows())]
        while self.accept("or"):
            parts.append(self.conjunction(False))
        parts = [p for p in parts if p is not None]
        return parts[0] if len(parts) == 1 else ast.Or(tuple(parts)) if parts else None

    def _or_follows(self) -> bool:
        depth = 0
        for t in self.tokens[self.i :]:
            if t.kind == "op":
                depth += (t.text == "(") - (t.text == ")")
            elif t.kind == "word" and depth == 0:
                if t.text.lower() in _CLAUSES:
                    return False
                if t.text.lower() == "or":
                    return True
        return False

    def conjunction(self, top: bool) -> ast.Condition | None:
        parts = [self.term(top)]
        while self.accept("and"):
            parts.append(self.term(top))
        parts = [p for p in parts if p is not None]
        return parts[0] if len(parts) == 1 else ast.And(tuple(parts)) if parts else None

    def term(self, top: bool) -> ast.Condition | None:
        if self.accept("not"):
            return ast.Not(self.term(False))
        if self.accept("("):
            found = self.disjunction(False)
            self.expect(")")
            return found
        name = self.identifier()
        if name.lower() == "time":
            if not top:
                raise QueryError("conditions on time join with AND only")
            self.time()
            return None
        if name.lower() == "value":
            return self.value()
        return self.tag(name)

    def time(self) -> None:
        if self.accept("between"):
            lo = self.instant()
            self.expect("and")
            self.bound(lo, self.instant())
            return
        op = self.expect(">=", ">", "<=", "<", "=").text
        t = self.instant()
        self.bound(t + (op == ">") if op in (">", ">=", "=") else None, t - (op == "<") if op in ("<", "<=", "=") else None)

    def bound(self, lo: int | None, hi: int | None) -> None:
        self.lo = lo if self.lo is None else self.lo if lo is None else max(self.lo, lo)
        self.hi = hi if self.hi is None else self.hi if hi is None else min(self.hi, hi)

    def instant(self) -> int:
        if self.accept("now"):
            self.expect("(")
            self.expect(")")
            if self.accept("-"):
                return self.now_ms - self.duration()
            if self.accept("+"):
                return self.now_ms + self.duration()
            return self.now_ms
        return self.whole()

    def value(self) -> ast.Condition:
        if self.accept("between"):
            lo = self.number()
            self.expect("and")
            return ast.Between(lo, self.number())
        negated = self.accept("not")
        if self.accept("in"):
            self.expect("(")
            found = [self.number()]
            while self.accept(","):
                found.append(self.number())
            self.expect(")")
            return ast.Not(ast.InSet(tuple(found))) if negated else ast.InSet(tuple(found))
        if self.accept("is"):
            negated = self.accept("not")
            self.expect("null")
            return ast.IsNull(negated)
        op = self.expect(">=", "<=", ">", "<", "=", "!=", "<>").text
        return ast.Compare("!=" if op == "<>" else op, self.number())

    def tag(self, name: str) -> ast.Condition:
        if self.accept("is"):
            negated = self.accept("not")
            self.expect("null")
            return ast.TagMatcher(name, "exists" if negated else "not_exists")
        negated = self.accept("not")
        if self.accept("in"):
            self.expect("(")
            found = [self.kind("text").text]
            while self.accept(","):
                found.append(self.kind("text").text)
            self.expect(")")
            m = ast.TagMatcher(name, "in", tuple(found))
            return ast.Not(m) if negated else m
        if self.accept("like"):
            m = ast.TagMatcher(name, "glob", self.kind("text").text.replace("%", "*"))
            return ast.Not(m) if negated else m
        op = self.expect("=", "!=", "<>", "=~", "!~").text
        return ast.TagMatcher(name, "!=" if op == "<>" else op, self.kind("text").text)

    # atoms

    def identifier(self) -> str:
        t = self.kind("word", "text")
        if len(t.text) > 256 or not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.\-:]*", t.text) or ".." in t.text:
            raise QueryError(f"not a name: {t.text!r}")
        return t.text

    def number(self) -> float:
        minus = self.accept("-")
        if self.sees("nan"):
            self.take()
            return float("nan")
        x = float(self.kind("number").text)
        return -x if minus else x

    def whole(self) -> int:
        t = self.kind("number").text
        if not re.fullmatch(r"-?\d+", t):
            raise QueryError(f"not a whole number: {t}")
        return int(t)

    def duration(self) -> int:
        t = self.kind("word", "number", "text").text
        try:
            ms = durations.parse(t)
        except ValueError as e:
            raise QueryError(str(e)) from None
        return ms
