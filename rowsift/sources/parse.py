"""Parsers of whole documents and of logfmt lines; plain Python, run in the executors."""

from __future__ import annotations

import json
import math
import tomllib
from collections.abc import Iterator
from typing import Any

from ..errors import FormatError


def json_text(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str)


def logfmt(line: str) -> dict[str, str]:
    """``key=value`` pairs; every value is a text; a word without ``=`` joins the next key, at the end it is an error."""
    out, rest = {}, line.strip()
    while rest:
        key, sign, rest = rest.partition("=")
        if not sign:
            raise FormatError(f"expected key=value, got '{key}'")
        if rest.startswith('"'):
            chars, i = [], 1
            while i < len(rest) and rest[i] != '"':
                i += rest[i] == "\\"
                chars.append(rest[i : i + 1])
                i += 1
            out[key.strip()], rest = "".join(chars), rest[i + 1 :]
        else:
            end = next((i for i, c in enumerate(rest) if c.isspace()), len(rest))
            out[key.strip()], rest = rest[:end], rest[end:]
        rest = rest.lstrip()
    return out


def json_documents(text: str) -> Iterator[dict]:
    """Concatenated values; arrays are flattened one level; anything but an object is an error."""
    decoder, at = json.JSONDecoder(), 0
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            return
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError as e:
            raise FormatError(f"invalid JSON: {e}") from e
        for item in value if isinstance(value, list) else [value]:
            if not isinstance(item, dict):
                raise FormatError(f"expected a JSON object, got {json_text(item)[:40]}")
            yield item


def _plain(value: Any) -> Any:
    if isinstance(value, dict):
        return {k if isinstance(k, str) else json_text(k) if isinstance(k, (bool, int, float)) else "_key": _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if value is None or isinstance(value, (bool, int, float, str)) else value.isoformat() if hasattr(value, "isoformat") else str(value)


def yaml_documents(text: str) -> Iterator[dict]:
    """Every document; a sequence gives one record an item, a scalar ``{"value": ...}``."""
    import yaml

    class Loader(yaml.SafeLoader):
        """Core schema: only true and false are booleans, dates stay texts, unknown tags are dropped."""

    Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    import re

    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))

    def untagged(loader, _suffix, node):
        if isinstance(node, yaml.MappingNode):
            return loader.construct_mapping(node, deep=True)
        return loader.construct_sequence(node, deep=True) if isinstance(node, yaml.SequenceNode) else loader.construct_scalar(node)

    Loader.add_multi_constructor("!", untagged)
    try:
        documents = list(yaml.load_all(text, Loader=Loader))
    except yaml.YAMLError as e:
        raise FormatError(f"invalid YAML: {e}") from e
    for document in documents:
        if document is None:
            continue
        for item in document if isinstance(document, list) else [document]:
            item = _plain(item)
            yield item if isinstance(item, dict) else {"value": item}


def toml_documents(text: str) -> Iterator[dict]:
    """The whole document is one record; dates and times become texts."""
    try:
        yield _plain(tomllib.loads(text))
    except tomllib.TOMLDecodeError as e:
        raise FormatError(f"invalid TOML: {e}") from e


WHOLE = {"json": json_documents, "yaml": yaml_documents, "toml": toml_documents}
