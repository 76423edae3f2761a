"""Parsed queries, as immutable values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TagMatcher:
    """op: = != =~ !~ exists not_exists prefix glob regex in."""

    key: str
    op: str
    value: str | tuple[str, ...] = ""


@dataclass(frozen=True)
class Compare:
    op: str
    value: float


@dataclass(frozen=True)
class Between:
    low: float
    high: float


@dataclass(frozen=True)
class InSet:
    values: tuple[float, ...]


@dataclass(frozen=True)
class IsNull:
    negated: bool = False


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: Condition


Condition = TagMatcher | Compare | Between | InSet | IsNull | And | Or | Not


@dataclass(frozen=True)
class Call:
    """An aggregate: its function, argument and column name."""

    function: str
    arg: float | None = None
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or self.function


@dataclass(frozen=True)
class Window:
    """interval_ms 0: chosen from the range. slide_ms: sliding; session: the interval is the session's gap."""

    interval_ms: int = 0
    slide_ms: int | None = None
    session: bool = False
    offset_ms: int = 0


@dataclass(frozen=True)
class Fill:
    """none null zero previous linear value."""

    kind: str = "none"
    value: float | None = None


@dataclass(frozen=True)
class Query:
    """kind: select, aggregate, downsample, latest, top. Times in ms, both ends included."""

    kind: str
    metric: str
    start_ms: int
    end_ms: int
    where: Condition | None = None
    columns: tuple[str, ...] = ("*",)
    calls: tuple[Call, ...] = ()
    window: Window | None = None
    group_by: tuple[str, ...] = ()
    fill: Fill = Fill()
    method: str = "lttb"
    target: int = 0
    order: tuple[tuple[str, bool], ...] = ()
    limit: int | None = None
    offset: int = 0
    explain: bool = False
