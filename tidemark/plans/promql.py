"""The PromQL subset: selectors, ranges, offset, aggregation by labels, the rate family, topk and quantile."""

from __future__ import annotations

from ..functions import durations
from . import ast
from .lexer import Cursor, QueryError

AGGREGATES = {"sum": "sum", "avg": "avg", "min": "min", "max": "max", "count": "count", "first": "first", "last": "last", "stddev": "stddev", "variance": "variance", "stdvar": "variance", "median": "median", "count_values": "count_distinct"}
RATES = ("rate", "increase", "delta", "idelta", "irate")
RANKS = ("topk", "bottomk", "quantile")
DEFAULT_RANGE_MS = 3_600_000
LOOKBACK_MS = 300_000


def parse(text: str, now_ms: int) -> ast.Query:
    """The query at now_ms. A range sets both the time range and tumbling windows of its length."""
    return _Parser(text, now_ms).query()


class _Parser(Cursor):
    def __init__(self, text: str, now_ms: int):
        super().__init__(text)
        self.now_ms = now_ms

    def query(self) -> ast.Query:
        q = self.expression()
        if self.now.kind != "end":
            self.fail("the end")
        return q

    def _calls(self) -> bool:
        return self.ahead().kind == "op" and self.ahead().text == "("

    def expression(self) -> ast.Query:
        word = self.now.text.lower()
        if self.now.kind == "word" and word in RANKS and self._calls():
            self.take()
            self.expect("(")
            number = float(self.kind("number").text)
            self.expect(",")
            sel = self.selector()
            self.expect(")")
            by = self.labels()
            return self.rank(word, number, sel, by)
        if self.now.kind == "word" and word in RATES and self._calls():
            self.take()
            self.expect("(")
            sel = self.selector()
            self.expect(")")
            if sel[2] is None:
                raise QueryError(f"{word} needs a range")
            return self.build("aggregate", sel, (ast.Call(word),))
        if self.now.kind == "word" and word in AGGREGATES and (self._calls() or self.ahead().text.lower() == "by"):
            self.take()
            by = self.labels()
            self.expect("(")
            sel = self.selector()
            self.expect(")")
            return self.build("aggregate", sel, (ast.Call(AGGREGATES[word], None, word),), by or self.labels())
        return self.build("select", self.selector(), ())

    def rank(self, word: str, number: float, sel: tuple, by: tuple[str, ...]) -> ast.Query:
        if word == "quantile":
            return self.build("aggregate", sel, (ast.Call("quantile", number),), by)
        if number != int(number) or number < 1:
            raise QueryError(f"{word} needs a positive whole number")
        q = self.build("top", sel, (ast.Call("last", None, "value"),))
        return ast.Query(**{**q.__dict__, "limit": int(number), "order": (("value", word == "topk"),)})

    def labels(self) -> tuple[str, ...]:
        if not self.accept("by"):
            return ()
        self.expect("(")
        out = [self.kind("word").text]
        while self.accept(","):
            out.append(self.kind("word").text)
        self.expect(")")
        return tuple(out)

    def selector(self) -> tuple[str, tuple, int | None]:
        name = self.kind("word").text
        matchers = []
        if self.accept("{"):
            while not self.sees("}"):
                key = self.kind("word").text
                op = self.expect("=", "!=", "=~", "!~").text
                matchers.append(ast.TagMatcher(key, op, self.kind("text").text))
                if not self.accept(","):
                    break
            self.expect("}")
        window = None
        if self.accept("["):
            window = self.duration()
            self.expect("]")
        return name, tuple(matchers), window

    def duration(self) -> int:
        try:
            return durations.parse(self.kind("word").text)
        except ValueError as e:
            raise QueryError(str(e)) from None

    def build(self, kind: str, sel: tuple, calls: tuple, by: tuple[str, ...] = ()) -> ast.Query:
        shift = self.duration() if self.accept("offset") else 0
        name, matchers, window = sel
        end = self.now_ms - shift
        where = None if not matchers else matchers[0] if len(matchers) == 1 else ast.And(matchers)
        span = window or DEFAULT_RANGE_MS
        w = ast.Window(window) if window and kind == "aggregate" else None
        return ast.Query(kind, name, end - span, end, where, ("*",), calls, w, by)
