"""Plan nodes; where the languages differ, a node carries what its own asks for."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# Predicates


@dataclass(frozen=True)
class And:
    left: Any
    right: Any


@dataclass(frozen=True)
class Or:
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    inner: Any


@dataclass(frozen=True)
class Exists:
    path: str


@dataclass(frozen=True)
class KeywordTest:
    """op: = != > < >= <= ~= contains startswith endswith glob between; values are texts."""

    path: str
    op: str
    value: str
    high: str = ""


@dataclass(frozen=True)
class ExpressionTest:
    """op: == != > < >= <= contains matches; value is a str, float, bool or None."""

    path: str
    op: str
    value: Any


# Arithmetic


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class FieldRef:
    path: str


@dataclass(frozen=True)
class Length:
    path: str


@dataclass(frozen=True)
class Arith:
    left: Any
    op: str
    right: Any


# Operators


@dataclass(frozen=True)
class Filter:
    predicate: Any


@dataclass(frozen=True)
class Cast:
    path: str
    type: str


@dataclass(frozen=True)
class Project:
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Omit:
    paths: tuple[str, ...]


@dataclass(frozen=True)
class MapExpr:
    out: str
    expr: Any


@dataclass(frozen=True)
class TextFn:
    """fn: to_lower to_upper replace split."""

    fn: str
    path: str
    args: tuple[str, ...] = ()


@dataclass(frozen=True)
class TimeAttr:
    """fn: hour_of_day day_of_week is_weekend."""

    fn: str
    path: str


@dataclass(frozen=True)
class Sort:
    path: str
    desc: bool = False


@dataclass(frozen=True)
class Limit:
    n: int


@dataclass(frozen=True)
class Skip:
    n: int


@dataclass(frozen=True)
class Dedup:
    path: str


@dataclass(frozen=True)
class CountAll:
    pass


@dataclass(frozen=True)
class CountBy:
    paths: tuple[str, ...]


@dataclass(frozen=True)
class CountByTime:
    path: str
    bucket: str
    asc: bool


@dataclass(frozen=True)
class CountUnique:
    """by_text: distinct string forms, a missing field counts as the empty text; else distinct JSON forms of present values."""

    path: str
    by_text: bool


@dataclass(frozen=True)
class TypeCount:
    path: str


@dataclass(frozen=True)
class Fields:
    pass


@dataclass(frozen=True)
class Stat:
    """fn: sum avg min max; empty_null: null for no number at all, else 0."""

    fn: str
    path: str
    empty_null: bool


AGGREGATES = (CountAll, CountBy, CountByTime, CountUnique, TypeCount, Fields, Stat)
ORDERED = (Sort, Limit, Skip, Dedup, CountBy, TypeCount)
ROW_WISE = (Filter, Cast, Project, Omit, MapExpr, TextFn, TimeAttr)


@dataclass(frozen=True)
class Plan:
    layer: str
    nodes: tuple = ()
    files: tuple[str, ...] = ()
    case_sensitive: bool = False
    warnings: tuple[str, ...] = field(default=())

    def describe(self) -> str:
        return "\n".join([f"layer: {self.layer}", *(f"  {n!r}" for n in self.nodes), *([f"files: {', '.join(self.files)}"] if self.files else [])])
