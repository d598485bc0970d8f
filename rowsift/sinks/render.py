"""Rows as text: ndjson, pretty, table, csv, raw; with optional colours."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from typing import Any

FORMATS = ("ndjson", "pretty", "table", "csv", "raw")
STREAMING = ("ndjson", "pretty", "raw")
CELL = 60
_RESET, _DIM, _BOLD = "\x1b[0m", "\x1b[2m", "\x1b[1m"
RED, GREEN, YELLOW, BLUE, MAGENTA, CYAN, WHITE = (f"\x1b[{n}m" for n in (31, 32, 33, 34, 35, 36, 97))
_LEVELS = {"error": RED, "err": RED, "fatal": RED, "critical": RED, "panic": RED, "warn": YELLOW, "warning": YELLOW, "info": GREEN, "debug": BLUE, "trace": _DIM}


def paint(key: str, value: Any, text: str) -> str:
    """The colour of a value follows its field: level words, HTTP status classes, times dim, messages bright, errors red."""
    low = key.lower()
    if low in ("level", "severity", "lvl") and isinstance(value, str):
        return f"{_LEVELS.get(value.lower(), WHITE)}{text}{_RESET}"
    if low in ("status", "status_code", "code") and isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"{ {2: GREEN, 3: CYAN, 4: YELLOW, 5: RED}.get(int(value) // 100, WHITE)}{text}{_RESET}"
    if low in ("ts", "time", "timestamp", "@timestamp"):
        return f"{_DIM}{text}{_RESET}"
    if low in ("msg", "message"):
        return f"{WHITE}{text}{_RESET}"
    if low in ("error", "err", "exception"):
        return f"{RED}{text}{_RESET}"
    if isinstance(value, bool):
        return f"{YELLOW}{text}{_RESET}"
    if isinstance(value, (int, float)):
        return f"{MAGENTA}{text}{_RESET}"
    return f"{_DIM}{text}{_RESET}" if value is None else text


def compact(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str)


def cell(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else compact(value)


def ndjson(rows: Iterable[dict], color: bool = False) -> Iterator[str]:
    for r in rows:
        yield "{" + ", ".join(f"{CYAN}{compact(k)}{_RESET}: {paint(k, v, compact(v))}" for k, v in r.items()) + "}" if color else compact(r)


def pretty(rows: Iterable[dict], color: bool = False) -> Iterator[str]:
    for i, r in enumerate(rows):
        if i:
            yield ""
        text = json.dumps(r, ensure_ascii=False, indent=2, default=str)
        if color:
            text = re.sub(r'^(\s*)("(?:[^"\\]|\\.)*"):', lambda m: f"{m[1]}{CYAN}{m[2]}{_RESET}:", text, flags=re.M)
        yield text


def header(rows: list[dict]) -> list[str]:
    """All names, in the order in which rows show them first."""
    return list(dict.fromkeys(k for r in rows for k in r))


def table(rows: Iterable[dict], color: bool = False) -> Iterator[str]:
    rows = list(rows)
    names = header(rows)
    if not names:
        return
    cells = [[c if len(c) <= CELL else c[: CELL - 1] + "…" for c in (cell(r.get(n)).replace("\n", " ") for n in names)] for r in rows]
    wide = [max(len(n), *(len(r[i]) for r in cells)) for i, n in enumerate(names)]
    line = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    yield line
    yield "|" + "|".join(f" {_BOLD if color else ''}{n.ljust(w)}{_RESET if color else ''} " for n, w in zip(names, wide, strict=True)) + "|"
    yield line
    for r, texts in zip(rows, cells, strict=True):
        yield "|" + "|".join(f" {paint(n, r.get(n), t.ljust(w)) if color else t.ljust(w)} " for n, t, w in zip(names, texts, wide, strict=True)) + "|"
    yield line


def csv(rows: Iterable[dict], color: bool = False) -> Iterator[str]:
    rows = list(rows)
    names = header(rows)
    if not names:
        return
    yield ",".join(names)
    for r in rows:
        texts = [cell(r.get(n)) for n in names]
        yield ",".join('"' + t.replace('"', '""') + '"' if any(c in t for c in ',"\r\n') else t for t in texts)


RENDERERS = {"ndjson": ndjson, "pretty": pretty, "table": table, "csv": csv}
