"""The two query languages."""

from __future__ import annotations

from ..plans.nodes import Plan
from . import expression, keyword


def layer_of(text: str) -> str:
    """A query that begins with a path, a pipe or ``not`` is an expression."""
    t = text.lstrip()
    return "expression" if t.startswith((".", "|")) or t.lower().startswith("not ") else "keyword"


def parse(text: str, layer: str | None = None, case_sensitive: bool = False, time_field: str = "ts") -> Plan:
    if (layer or layer_of(text)) == "expression":
        return expression.parse(text, case_sensitive)
    return keyword.parse(text, case_sensitive, time_field)
