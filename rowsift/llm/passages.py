"""Passages of a fixed number of tokens that occur several times: what both exact finders share.

A token is a run of non-blank characters, as it stands.  A window is ``WINDOW`` tokens.  Each window
has an anchor, the smallest of its 16-grams; equal windows have equal anchors, and few
places of a text are anchors, one in some 18 tokens.  All windows in a row with one anchor make up a
context: the tokens that these windows cover.  Anchors and contexts are named by 64 bits each, so a context by 128.

Equal contexts hold equal windows, so whatever is asked of windows is asked once for each distinct
context, and the answer goes to all its occurrences.  A context whose anchor has no other context shares no window with
one; only contexts that differ under one anchor have to be compared window by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_ids, keep_ids
from .textkit import SOLID, Tokens, U, gram_hashes, mix, run_hashes, signed, slices, text_buffers, window_minima, window_starts

WINDOW, ANCHOR = 50, 16
#: End of a context, whatever its length.
ALL = 2**31 - 1


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id and text of the rows that have both, and ``th`` to tell texts of a doc_id apart; equal rows once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    rows = rows.withColumn("th", F.xxhash64("text").bitwiseAND(0x7FFFFFFF).cast("int"))
    twice = rows.groupBy("doc_id", F.xxhash64("text").alias("h")).count().where("count > 1").select("doc_id").distinct()
    return rows if twice.isEmpty() else drop_ids(rows, twice).unionByName(keep_ids(rows, twice).dropDuplicates())


class Windows:
    """Windows of a slice with their anchors and contexts; ``texts`` is the string column."""

    def __init__(self, texts: pa.Array):
        self.tok = Tokens(*text_buffers(texts), SOLID)
        self.h = self.tok.hashes()
        self.at = window_starts(self.tok.bounds, WINDOW)
        grams = gram_hashes(self.h, ANCHOR)
        anchor = window_minima(grams, WINDOW - ANCHOR + 1)[self.at] if len(self.at) else self.at
        row = np.searchsorted(self.tok.bounds, self.at, "right") - 1
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])) if len(self.at) else self.at
        end = np.append(new[1:], len(self.at))
        #: For each context: its row, anchor, tokens from lo to hi + WINDOW (by place in the slice) and first window by place in the text.
        self.row, self.key = row[new], grams[anchor[new]]
        self.lo, self.hi = self.at[new], self.at[end - 1] if len(new) else self.at
        self.ctx = run_hashes(self.h, self.lo, self.hi + WINDOW)
        self.base = self.tok.bounds[:-1][self.row]


OCCURRENCES = "key long, ctx long, doc_id long, th int, lo int, hi int"


def occurrences(rows: DataFrame) -> DataFrame:
    """(key, ctx, doc_id, th, lo, hi): every context of every text; windows lo to hi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Windows(part.column(1))
                at = pa.array(w.row)
                cols = [pa.array(signed(w.key)), pa.array(signed(w.ctx)), part.column(0).take(at), part.column(2).take(at), pa.array((w.lo - w.base).astype(np.int32)), pa.array((w.hi - w.base).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "ctx", "doc_id", "th", "lo", "hi"])

    return rows.select("doc_id", "text", "th").mapInArrow(run, OCCURRENCES)


def wanted(w: Windows, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(which context of w, value) of the contexts that each row's list of structs (key, ctx, c) asks for, each the first time it stands there."""
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    name = lambda row, key, ctx: mix(key + mix(ctx + mix(row.astype(np.uint64))))
    asked = name(rows, flat.field("key").to_numpy().view(np.uint64), flat.field("ctx").to_numpy().view(np.uint64))
    have, first = np.unique(name(w.row, w.key, w.ctx), return_index=True)
    at = np.searchsorted(have, asked)
    ok = at < len(have)
    ok[ok] = have[at[ok]] == asked[ok]
    return first[at[ok]], flat.field("c").to_numpy()[ok]


def streamed(batches: Iterator[pa.RecordBatch], groups: int, most: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut only where the first ``groups`` columns change; a larger group comes whole."""
    held: list[list[np.ndarray]] = []
    n, enough = 0, most
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n < enough:
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        edge = np.flatnonzero(changes(cols[:groups]))
        end = int(edge[-1])
        if end:
            yield [c[:end] for c in cols]
        held, n = [[c[end:] for c in cols]], len(cols[0]) - end
        enough = max(most, 2 * n)  # a group larger than that is copied a few times, not once a batch
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def changes(cols: list[np.ndarray]) -> np.ndarray:
    """Where the columns differ from the row before; true for the first row."""
    out = np.ones(len(cols[0]), dtype=bool)
    if len(out):
        out[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return out


def ranges(c: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of neighbouring p within equal c."""
    new = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (p[1:] != p[:-1] + 1)])) if len(c) else np.zeros(0, dtype=np.int64)
    return new, np.append(new[1:], len(c)) - 1 if len(c) else new


def spans(stretches: DataFrame, *kept: str) -> DataFrame:
    """(doc_id, start, n_words, ...): stretches (doc_id, th, s, e, ...) of windows, neighbours joined; the further columns are those of the first window."""
    w = Window.partitionBy("doc_id", "th").orderBy("s")
    marked = stretches.withColumn("new", F.coalesce((F.col("s") != F.lag("e").over(w) + 1).cast("int"), F.lit(1)))
    joined = marked.withColumn("run", F.sum("new").over(w))
    head = [F.max(F.when(F.col("new") == 1, F.col(c))).alias(c) for c in kept]
    out = joined.groupBy("doc_id", "th", "run").agg(F.min("s").alias("start"), (F.max("e") - F.min("s") + WINDOW).cast("int").alias("n_words"), *head)
    return out.drop("run")


__all__ = ["ALL", "ANCHOR", "U", "WINDOW", "Windows", "changes", "occurrences", "ranges", "rows_of", "spans", "streamed", "wanted"]
