"""A fluent way to write queries."""

from __future__ import annotations

from collections.abc import Iterable

from ..functions import durations
from . import ast
from .lexer import QueryError

MOST_SPAN_MS = 366 * 86_400_000


class QueryBuilder:
    """QueryBuilder("cpu").range(lo, hi).tag("host", "a").aggregate("avg").window("5m").build()"""

    def __init__(self, metric: str):
        self._q: dict = {"kind": "select", "metric": metric, "start_ms": None, "end_ms": None}
        self._where: list = []
        self._calls: list[ast.Call] = []

    def _with(self, **parts) -> QueryBuilder:
        self._q |= parts
        return self

    def range(self, start_ms: int, end_ms: int) -> QueryBuilder:
        if start_ms > end_ms:
            raise QueryError("the range ends before it starts")
        return self._with(start_ms=start_ms, end_ms=end_ms)

    def tag(self, key: str, value: str | Iterable[str] = "", op: str = "=") -> QueryBuilder:
        self._where.append(ast.TagMatcher(key, op, value if isinstance(value, str) else tuple(value)))
        return self

    def any_tag(self, *matchers: ast.TagMatcher) -> QueryBuilder:
        """Any of the matchers instead of all."""
        self._where.append(ast.Or(tuple(matchers)))
        return self

    def filter(self, condition: ast.Condition) -> QueryBuilder:
        self._where.append(condition)
        return self

    def value(self, op: str, number: float) -> QueryBuilder:
        return self.filter(ast.Compare(op, number))

    def columns(self, *names: str) -> QueryBuilder:
        return self._with(columns=names)

    def aggregate(self, function: str, arg: float | None = None, alias: str | None = None) -> QueryBuilder:
        self._calls.append(ast.Call(function, arg, alias))
        return self._with(kind="aggregate")

    def window(self, interval: str = "auto", slide: str | None = None, offset: str | None = None) -> QueryBuilder:
        size = 0 if interval == "auto" else durations.parse(interval)
        step = durations.parse(slide) if slide else None
        if size > MOST_SPAN_MS or step and (step > size or step <= 0):
            raise QueryError("a window is at most a year and its step at most the window")
        return self._with(window=ast.Window(size, step, False, durations.parse(offset) if offset else 0))

    def sessions(self, gap: str) -> QueryBuilder:
        return self._with(window=ast.Window(durations.parse(gap), None, True))

    def group_by(self, *tags: str) -> QueryBuilder:
        return self._with(group_by=tags)

    def fill(self, kind: str, value: float | None = None) -> QueryBuilder:
        return self._with(fill=ast.Fill(kind, value))

    def downsample(self, target: int, method: str = "lttb") -> QueryBuilder:
        return self._with(kind="downsample", target=target, method=method)

    def latest(self, n: int = 1) -> QueryBuilder:
        return self._with(kind="latest", limit=n)

    def order_by(self, field: str, descending: bool = False) -> QueryBuilder:
        return self._with(order=(*self._q.get("order", ()), (field, descending)))

    def limit(self, n: int, offset: int = 0) -> QueryBuilder:
        return self._with(limit=n, offset=offset)

    def explain(self) -> QueryBuilder:
        return self._with(explain=True)

    def stream(self, live):
        """The query over a stream of points."""
        from ..streaming import queries

        return queries.run(self.build(), live)

    def build(self) -> ast.Query:
        if self._q["start_ms"] is None:
            raise QueryError("a range is needed")
        if self._q["kind"] == "aggregate" and not self._calls:
            raise QueryError("an aggregate is needed")
        where = None if not self._where else self._where[0] if len(self._where) == 1 else ast.And(tuple(self._where))
        return ast.Query(where=where, calls=tuple(self._calls), **self._q)
