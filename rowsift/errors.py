"""Errors that users see."""

from __future__ import annotations


class QueryError(ValueError):
    """A query that cannot be read; ``pos`` is the offset in the text, if known."""

    def __init__(self, message: str, text: str = "", pos: int | None = None, hint: str = ""):
        self.message, self.text, self.pos, self.hint = message, text, pos, hint
        lines = [message]
        if text and pos is not None:
            lines += [f"  {text}", f"  {' ' * pos}^"]
        if hint:
            lines.append(f"  hint: {hint}")
        super().__init__("\n".join(lines))


class FormatError(ValueError):
    """An input that cannot be parsed in its format."""


def distance(a: str, b: str) -> int:
    """Levenshtein distance, for suggestions."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(last, row[j], row[j - 1])
    return row[-1]


def suggestion(word: str, known: list[str], most: int = 2) -> str | None:
    best = min(known, key=lambda k: distance(word.lower(), k.lower()), default=None)
    return best if best is not None and distance(word.lower(), best.lower()) <= most else None
