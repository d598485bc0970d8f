"""The engine: a query text over a DataFrame, a frame or files."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import replace
from datetime import date, datetime
from decimal import Decimal
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import lang
from .errors import QueryError, suggestion
from .operators.frame import HIDDEN, Frame
from .operators.lower import CAST_TYPES, bad_numbers, cast_problem, lower
from .plans import nodes as N
from .plans.normalize import needs_order, normalize
from .sinks import render
from .sources import readers

WARNED = 5


def parse_casts(casts: dict[str, str] | list[str] | None) -> tuple[N.Cast, ...]:
    """Casts from a mapping or from FIELD=TYPE texts."""
    if not casts:
        return ()
    pairs = casts.items() if isinstance(casts, dict) else [c.split("=", 1) if "=" in c else (c, None) for c in casts]
    out = {}
    for name, kind in pairs:
        if kind is None:
            raise QueryError(f"a cast is FIELD=TYPE, got '{name}'", hint="for example latency=number")
        if kind.lower() not in CAST_TYPES:
            close = suggestion(kind, list(CAST_TYPES))
            raise QueryError(f"unknown type '{kind}' in the cast of '{name}'", hint=(f"did you mean {close}? " if close else "") + "types are number, string, bool, null, auto")
        out[name] = N.Cast(name, kind.lower())
    return tuple(out.values())


def plain(value: Any) -> Any:
    """A row's value as JSON would have it."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, datetime):
        return value.isoformat().replace("+00:00", "") + "Z"
    if isinstance(value, date):
        return value.isoformat() + "T00:00:00Z"
    if hasattr(value, "toPython"):
        return value.toPython()
    return float(value) if isinstance(value, Decimal) else value


class Result:
    """What a query gives: ``df`` for Spark, ``records()`` for the driver, ``warnings`` on demand."""

    def __init__(self, plan: N.Plan, source: Frame, frame: Frame, strict: bool):
        self.plan, self.source, self.frame, self.strict = plan, source, frame, strict

    @cached_property
    def _in_order(self) -> Frame:
        return self.frame if self.frame.order or self.source.position is None else lower(self.plan, self.source.ordered(), self.strict)

    @cached_property
    def ordered(self) -> DataFrame:
        f = self._in_order
        return f.df.orderBy(*f.order) if f.order else f.df

    @property
    def df(self) -> DataFrame:
        """The result without hidden columns; sorted only if the query says so."""
        sorts = any(isinstance(n, N.Sort) for n in self.plan.nodes) or any(isinstance(n, (N.CountBy, N.CountByTime, N.TypeCount, N.Fields)) for n in self.plan.nodes[-1:])
        df = self.ordered if sorts and not isinstance(self.plan.nodes[-1], (N.CountAll, N.Stat, N.CountUnique)) else self.frame.df
        return df.drop(*[c for c in df.columns if c in HIDDEN or c.startswith("__")])

    def records(self) -> Iterator[dict]:
        """Rows as dicts, in order; absent fields are left out."""
        frame = self._in_order
        if frame.dynamic:
            for row in self.ordered.select(F.to_json("fields").alias("json")).toLocalIterator():
                yield json.loads(row.json)
            return
        names = frame.names
        for row in self.ordered.select(*(F.col(f"`{n}`") for n in names)).toLocalIterator():
            yield {n: plain(v) for n, v in zip(names, row, strict=True) if v is not None or n not in frame.missing}

    def raw(self) -> Iterator[str]:
        """The original texts; rows that have none are empty lines."""
        if "_raw" not in self.frame.df.columns:
            yield from ("" for _ in self.records())
            return
        for row in self.ordered.select("_raw").toLocalIterator():
            yield row[0] or ""

    def render(self, fmt: str = "ndjson", color: bool = False) -> Iterator[str]:
        return self.raw() if fmt == "raw" else render.RENDERERS[fmt](self.records(), color)

    @cached_property
    def warnings(self) -> list[str]:
        """What was skipped on the way; runs queries of its own, five examples a kind at most."""
        out = list(self.plan.warnings)
        for bad, message in self.source.warnings:
            out += _sampled(bad.select(F.col("value").alias("shown")), message)
        frame = self.source.ordered() if self.source.order or needs_order(self.plan) else self.source
        for node in self.plan.nodes:
            if isinstance(node, N.Cast):
                text = frame.value(node.path).text
                out += _sampled(frame.df.where(cast_problem(node, frame)).select(text.alias("shown")), f"cast {node.path}={node.type}: field skipped, not a {node.type}")
            if isinstance(node, N.Stat):
                text = frame.value(node.path).text
                out += _sampled(frame.df.where(bad_numbers(node, frame)).select(text.alias("shown")), f"{node.fn} {node.path}: not a number")
                if node.empty_null and frame.df.select(frame.value(node.path).num.alias("x")).where("x is not null").isEmpty():
                    out.append(f"{node.fn} {node.path}: no numeric value")
            if isinstance(node, N.AGGREGATES):
                break
            frame = lower(replace(self.plan, nodes=(node,)), frame, self.strict)
        return out

    def explain(self, mode: str = "formatted") -> str:
        plan = self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
        return self.plan.describe() + "\n\n" + plan


def _sampled(bad: DataFrame, message: str) -> list[str]:
    rows = bad.limit(WARNED).collect()
    out = [f"{message}: {r.shown!r}" for r in rows]
    if len(rows) == WARNED and (n := bad.count()) > WARNED:
        out.append(f"{n - WARNED} more of these suppressed")
    return out


class Engine:
    """Runs queries on a session.  The session time zone must be UTC, as labels and attributes are in UTC."""

    def __init__(self, spark: SparkSession, strict: bool = False, time_field: str = "ts"):
        self.spark, self.strict, self.time_field = spark, strict, time_field
        if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "GMT"):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        # of a key that a record repeats the last value counts
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
        spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")

    def frame(self, source: DataFrame | Frame | str | list[str], **options) -> Frame:
        if isinstance(source, Frame):
            return source
        if isinstance(source, DataFrame):
            return readers.from_dataframe(source)
        paths = [source] if isinstance(source, str) else list(source)
        return readers.concat([readers.read(self.spark, p, file_index=i, **options) for i, p in enumerate(paths)])

    def query(self, source: DataFrame | Frame | str | list[str] | None, text: str, case_sensitive: bool = False, casts: dict[str, str] | list[str] | None = None, layer: str | None = None, now: int | None = None, **options) -> Result:
        """Parses, normalises and lowers; nothing runs until the result is used."""
        plan = lang.parse(text, layer, case_sensitive, self.time_field)
        if source is None:
            source = list(plan.files)
        elif plan.files and isinstance(source, (DataFrame, Frame)):
            raise QueryError(f"cannot read '{' '.join(plan.files)}'", hint="check the spelling of clauses; the query has its source already")
        plan = replace(plan, nodes=(*parse_casts(casts), *plan.nodes))
        return self.run(plan, self.frame(source, **options), now)

    def run(self, plan: N.Plan, frame: Frame, now: int | None = None) -> Result:
        plan = normalize(plan, now)
        return Result(plan, frame, lower(plan, frame, self.strict), self.strict)
