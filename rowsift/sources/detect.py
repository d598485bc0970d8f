"""Format of an input, from its name and the head of its content."""

from __future__ import annotations

FORMATS = ("ndjson", "json", "csv", "tsv", "logfmt", "yaml", "toml", "text", "parquet", "gzip")
_BY_ENDING = {".gz": "gzip", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".tsv": "tsv", ".csv": "csv", ".ndjson": "ndjson", ".parquet": "parquet"}
HEAD = 512


def sniff(head: bytes, name: str | None = None) -> str:
    """gzip magic, then the ending, then the content; ``.json`` and ``.log`` decide nothing."""
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:4] == b"PAR1":
        return "parquet"
    for ending, kind in _BY_ENDING.items():
        if name and name.lower().endswith(ending):
            return kind
    text = head[:HEAD].decode("utf-8", "replace").lstrip()
    first = text.split("\n", 1)[0]
    if text.startswith("{"):
        return _json_kind(text)
    if text.startswith("["):
        return "toml" if _is_toml(first) else "json"
    if text.startswith(("---", "- ")):
        return "yaml"
    if _is_toml(first):
        return "toml"
    if sum("=" in word for word in first.split()) >= 2:
        return "logfmt"
    return "csv" if "," in first else "text"


def _json_kind(text: str) -> str:
    first, newline, rest = text.partition("\n")
    rest = rest.lstrip()
    return "ndjson" if not newline or not rest or rest.startswith("{") or first.strip().endswith("}") else "json"


def _is_toml(line: str) -> bool:
    if line.startswith("["):
        inner, close, _ = line[1:].partition("]")
        if close and inner and not any(c in inner for c in "{\"'"):
            return True
    key, sign, _ = line.partition(" = ")
    return bool(sign and key and ":" not in key)
