"""JSON documents in splits: a file is cut after closing braces, wherever they stand, and read in two passes.

The first pass sums up each block, once for the case that it begins outside of a string and once for inside: which brackets find no
partner in it.  From these few bytes a block the driver tells where each begins: how deep, in what, inside of a string or not.  The
second pass then cuts the records out of the blocks and parses them one by one; of a record that goes on in the next blocks the pieces
are put together.  No task holds more than a batch of lines and one record.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa

from ..errors import FormatError
from .parse import json_text

_ESCAPE = re.compile(rb"\\.", re.DOTALL)
_MARKS = np.zeros(256, np.bool_)
_MARKS[list(b'"[]{}')] = True
_BLANK = b" \t\n\r"
#: Brackets open at the end of a block; a parser gives up long before.
DEEPEST = 100_000
#: Bytes that are cut at once, and records that are returned at once.
PIECE, RECORDS = 1 << 20, 10_000
SUMMARY = "file long, block long, bytes long, odd boolean, closed0 long, opened0 binary, closed1 long, opened1 binary"
CUT = "file long, block long, owner long, row long, json string, part binary"


class Start(NamedTuple):
    """How a block begins: inside of a string, how deep, in an array of records; the block where the record began that is open; whether a brace ends the block; how it ends."""

    inside: bool
    depth: int
    listed: bool
    owner: int | None
    ended: bool
    last_depth: int = 0
    last_inside: bool = False


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(place, bracket, whether the quotes before are odd in number) of the brackets; whether all quotes are."""
    text = np.frombuffer(_ESCAPE.sub(b"__", data) if b"\\" in data else data, np.uint8)
    at = np.flatnonzero(_MARKS[text])
    chars = text[at]
    quote = chars == ord('"')
    odd = (np.cumsum(quote) & 1).astype(np.bool_)
    return at[~quote], chars[~quote], odd[~quote], bool(len(odd) and odd[-1])


def _steps(chars: np.ndarray) -> np.ndarray:
    return np.where((chars == ord("{")) | (chars == ord("[")), 1, -1)


def _unpaired(chars: np.ndarray) -> tuple[int, bytes]:
    """How many closing brackets, and which opening ones, have no partner."""
    if not len(chars):
        return 0, b""
    step = _steps(chars)
    depth = np.cumsum(step)
    after = np.minimum.accumulate(depth[::-1])[::-1]
    return max(0, -int(depth.min())), chars[(step > 0) & (after == depth)].tobytes()


def _joined(a: tuple[int, bytes] | None, b: tuple[int, bytes]) -> tuple[int, bytes] | None:
    if a is None:
        return None
    met = min(len(a[1]), b[0])
    out = a[0] + b[0] - met, a[1][: len(a[1]) - met] + b[1]
    return out if len(out[1]) <= DEEPEST else None


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[bytes]]]:
    """((file, block), texts between braces), in the order of the file, a piece at a time."""
    for batch in batches:
        files, blocks = batch.column("file").to_numpy(), batch.column("block").to_numpy()
        edges = np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(files)], strict=True):
            texts, held, n = batch.column("value").slice(lo, hi - lo).to_pylist(), [], 0
            for text in texts:
                held.append(text)
                n += len(text) + 1
                if n >= PIECE:
                    yield (int(files[lo]), int(blocks[lo])), held
                    held, n = [], 0
            if held:
                yield (int(files[lo]), int(blocks[lo])), held


def summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a block; the brace at its very end isn't counted in."""
    at, size, odd, sums = None, 0, False, [(0, b""), (0, b"")]

    def row() -> pa.RecordBatch:
        cells = {"file": at[0], "block": at[1], "bytes": size, "odd": odd}
        for k, s in enumerate(sums):
            cells |= {f"closed{k}": None if s is None else s[0], f"opened{k}": None if s is None else s[1]}
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cells.values(), types, strict=True)], names=list(cells))

    for key, texts in _pieces(batches):
        if key != at:
            if at is not None:
                yield row()
            at, size, odd, sums = key, 0, False, [(0, b""), (0, b"")]
            data = b"}".join(texts)
        else:
            data = b"}" + b"}".join(texts)
        size += sum(map(len, texts)) + len(texts)
        _, chars, flags, flips = _marks(data)
        part = [_unpaired(chars[~flags]), _unpaired(chars[flags])]
        sums = [_joined(s, part[k ^ odd]) for k, s in enumerate(sums)]
        odd ^= flips
    if at is not None:
        yield row()


def starts(rows: list, sizes: dict[int, int], names: dict[int, str]) -> dict[tuple[int, int], Start]:
    """How each block begins, by the summaries of all."""
    out: dict[tuple[int, int], Start] = {}
    by_file: dict[int, list] = {}
    for r in rows:
        by_file.setdefault(r.file, []).append(r)
    for file, blocks in by_file.items():
        blocks.sort(key=lambda r: r.block)
        beyond = sum(r.bytes for r in blocks) - sizes[file]
        inside, stack, owner = False, b"", None
        for r in blocks:
            # a byte order mark, of three bytes, isn't among the texts
            ended = r is not blocks[-1] or beyond in (0, -3)
            start = Start(inside, len(stack), stack[:1] == b"[", owner, ended)
            closed, opened = (r.closed1, r.opened1) if inside else (r.closed0, r.opened0)
            before = len(stack)
            if closed is None or closed > before:
                raise FormatError(f"{names[file]}: invalid JSON: brackets don't match")
            least = before - closed
            stack, inside = stack[:least] + bytes(opened), inside ^ r.odd
            if ended and not inside:
                if not stack:
                    raise FormatError(f"{names[file]}: invalid JSON: brackets don't match")
                stack = stack[:-1]
                least = min(least, len(stack))
            out[file, r.block] = start._replace(last_depth=len(stack), last_inside=inside)
            base = 1 if stack[:1] == b"[" else 0
            if len(stack) <= base:
                owner = None
            elif owner is None or least <= base:  # the record that is open now began in this block
                owner = r.block
        if stack or inside:
            raise FormatError(f"{names[file]}: invalid JSON: it ends too early")
    return out


def record(text: bytes, name: str) -> str:
    """A record as a compact text."""
    try:
        value = json.loads(text.decode("utf-8"))
    except UnicodeDecodeError as e:
        raise FormatError(f"{name}: not valid UTF-8") from e
    except ValueError as e:
        raise FormatError(f"{name}: invalid JSON: {e}") from e
    if not isinstance(value, dict):
        raise FormatError(f"{name}: expected a JSON object, got {json_text(value)[:40]}")
    return json_text(value)


class _Block:
    """Cuts the records out of one block, piece by piece."""

    def __init__(self, start: Start, name: str):
        self.inside, self.depth, self.listed, self.owner, self.ended, *self.last = start
        self.name = name
        self.open = self.depth > (1 if self.listed else 0)
        self.held: list[bytes] = []
        self.first = False  # nothing came yet in the array
        self.parts: list[tuple[int | None, bytes]] = []

    def _between(self, text: bytes, wanted: bytes, listed: bool) -> None:
        if text.strip(_BLANK) != wanted:
            said = text.decode("utf-8", "replace").strip()
            if listed or said:  # between documents any blanks will do
                raise FormatError(f"{self.name}: expected JSON objects, with commas between those of an array, got {said[:40]!r}")

    def cut(self, data: bytes) -> Iterator[bytes]:
        """The texts of the records that end in this piece and began in this block."""
        at, chars, odd, flips = _marks(data)
        real = odd == self.inside
        at, chars = at[real], chars[real]
        self.inside ^= flips
        step = _steps(chars)
        depth = self.depth + np.cumsum(step)
        top = np.flatnonzero((step > 0) & (depth == 1))
        listed = np.full(len(chars), self.listed)
        if len(top):
            last = np.searchsorted(top, np.arange(len(chars)), side="right") - 1
            listed = np.where(last >= 0, chars[top[np.maximum(last, 0)]] == ord("["), listed)
        base = listed.astype(np.int64)
        starts_, ends = (step > 0) & (depth == base + 1), (step < 0) & (depth == base)
        array = listed & (((step > 0) & (depth == 1)) | ((step < 0) & (depth == 0)))
        done = 0
        for i in np.flatnonzero(starts_ | ends | array):
            p = int(at[i])
            if ends[i] and not array[i]:
                text = b"".join([*self.held, data[done : p + 1]])
                if self.owner is None:
                    yield text
                else:
                    self.parts.append((self.owner, text))
                self.held, done, self.open, self.owner, self.first = [], p + 1, False, None, False
                continue
            text = b"".join([*self.held, data[done:p]])
            self.held = []
            if array[i]:
                self._between(text, b"", step[i] < 0)
                if step[i] < 0 and chars[i] != ord("]"):
                    raise FormatError(f"{self.name}: invalid JSON: brackets don't match")
                self.first, done = True, p + 1
            else:
                self._between(text, b"," if listed[i] and not self.first else b"", bool(listed[i]))
                self.open, done = True, p
        self.held.append(data[done:])
        if len(chars):
            self.depth, self.listed = int(depth[-1]), bool(listed[-1])

    def finish(self, block: int) -> None:
        text = b"".join(self.held)
        if [self.depth, self.inside] != self.last:  # a backslash outside of a string
            raise FormatError(f"{self.name}: invalid JSON: brackets don't match")
        if self.open:
            self.parts.append((block if self.owner is None else self.owner, text))
        else:
            self._between(text, b"", False)


def cutter(begin: dict[tuple[int, int], Start], names: dict[int, str], places: dict[int, int], whole: bool):
    """For mapInArrow, records (``whole``), or the pieces of those that lie in several blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, row = None, None, 0
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["file", "block", "owner", "row", "json", "part"])
            out.clear()
            return made

        def take(data: bytes) -> None:
            nonlocal row
            for text in block.cut(data):
                if whole:
                    out.append((places[at[0]], at[1], at[1], row, record(text, names[at[0]]), None))
                row += 1

        def close() -> None:
            if block.ended:
                take(b"}")
            block.finish(at[1])
            if not whole:
                out.extend((places[at[0]], at[1], owner, 0, None, part) for owner, part in block.parts)

        for key, texts in _pieces(batches):
            data = b"}".join(texts)
            if key != at:
                if at is not None:
                    close()
                at, block, row = key, _Block(begin[key], names[key[0]]), 0
            else:
                data = b"}" + data
            take(data)
            if len(out) >= RECORDS:
                yield batch()
        if at is not None:
            close()
        if out:
            yield batch()

    return run


def mended(paths: list[str]):
    """For applyInPandas: the record whose pieces these are, behind the other records of its block."""

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("block")
        file, owner = int(parts["file"].iloc[0]), int(parts["owner"].iloc[0])
        return pd.DataFrame({"file": [file], "block": [owner], "row": [(1 << 33) - 1], "json": [record(b"".join(parts["part"]), paths[file])]})

    return run
