"""Regular expressions: linear-time dialect in, Java dialect out."""

from __future__ import annotations

import re

_REJECTED = re.compile(r"\(\?(?:[=!]|<[=!]|>|\()|\\[1-9]|\\k|[*+?}]\+")


def translate(pattern: str) -> str:
    """Java pattern with the same matches; raises ValueError for what the dialect lacks."""
    bare = re.sub(r"\\\\", "", pattern)
    if _REJECTED.search(re.sub(r"\[[^\]]*\]", "", bare)):
        raise ValueError("look-around, back-references and possessive repeats are not supported")
    check = re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", pattern)
    check = re.sub(r"\\[pP](?:\{\^?\w+\}|\w)", r"\\w", check).replace(r"\z", r"\Z")
    try:
        re.compile(check)
    except re.error as e:
        raise ValueError(str(e)) from e
    out = re.sub(r"\(\?P<", "(?<", pattern)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\$$", r"\1\\z", out)
    return "(?dU)" + re.sub(r"\(\?i\)", "(?iu)", out)


def glob(pattern: str) -> str:
    """Whole-text, case-blind pattern of * and ?."""
    return "(?iudU)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) if not c.isalnum() and c.isascii() and c not in " _" else c for c in pattern) + r"\z"
