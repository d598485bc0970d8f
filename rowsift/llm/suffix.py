"""Suffix-array deduplication by bucket-pointer refinement.

The suffixes of the texts, by tokens, fall into buckets of equal first 13 tokens.  A refinement sorts the suffixes
by the bucket of each and by the bucket of the suffix some offset later, and gives every group of equal pairs a bucket identifier
of its own, the place of its head in the sorted order; suffixes alone in their bucket are sorted for good and drop out.  The new identifiers are looked up
again at later offsets for the next refinement: 13 tokens become 26 by the offset 13, and 26 become 50 by the offset 24, where a
bucket is a class of equal windows.

Suffixes that need no sorting are kept out: equal contexts (see passages) stand for one another, and a context whose anchor
has no other context is alone in its buckets.  Only the suffixes of the distinct contexts that differ under one anchor are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, small, table
from .passages import ALL, Windows, changes, occurrences, ranges, rows_of, spans, streamed, wanted
from .textkit import gram_hashes, ragged_take, signed, slices

#: Tokens of an initial bucket, and the offsets at which the buckets of later suffixes refine them: 13 + 13 = 26, 26 + 24 = 50.
FIRST, OFFSETS = 13, (13, 24)
ROWS_AT_ONCE = 200_000
SUFFIXES = "b long, later long, c long, p int"
BUCKETS = "c long, p int, b long"


def initial_buckets(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """(b, later, c, p): the suffixes of contexts (key, ctx, c, doc0) with their buckets and those at the first offset.

    A context is read where it occurs first, in the text of doc0.  Its suffixes go on behind its last window as far as the
    last refinement looks.
    """
    lists = contexts.groupBy(F.col("doc0").alias("in_doc")).agg(F.collect_list(F.struct("key", "ctx", "c")).alias("asked"))
    n, m = contexts.count(), contexts.select("doc0").distinct().count()
    texts = rows.join(small(lists, 1, 32 * n + 24 * m), F.col("doc_id") == F.col("in_doc")).select("text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Windows(part.column(0))
                which, c = wanted(w, part.column(1))
                size = w.hi[which] - w.lo[which] + 1 + OFFSETS[1]
                b = gram_hashes(w.h, FIRST)
                p = ragged_take(np.arange(int(size.max()) if len(size) else 0), np.zeros(len(size), dtype=np.int64), size)
                at = np.repeat(w.lo[which], size) + p
                yield pa.RecordBatch.from_arrays([pa.array(signed(b[at])), pa.array(signed(b[at + OFFSETS[0]])), pa.array(np.repeat(c, size)), pa.array(p.astype(np.int32))], names=["b", "later", "c", "p"])

    return texts.mapInArrow(run, SUFFIXES)


def refine(suffixes: DataFrame) -> DataFrame:
    """(c, p, b): the suffixes (b, later, c, p) with their refined bucket identifiers; those alone in their bucket are left out.

    A bucket passes through its task in sorted order and is never held: only whether it goes on has to be known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        done, head, last = 0, -1, None  # rows before the batch, head of the open bucket, last row held back
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if last is not None:
                cols = [np.concatenate([[x], c]) for x, c in zip(last, cols, strict=True)]
            once = changes(cols)  # texts that share a doc_id may give a suffix twice
            cols = [c[once] for c in cols]
            new = changes(cols[:2])
            if last is not None:
                new[0] = head == done
            if len(new) > 1:
                starts = np.where(new, np.arange(len(new)) + done, -1)
                if not new[0]:
                    starts[0] = head
                heads = np.maximum.accumulate(starts)
                alone = new[:-1] & new[1:]
                keep = np.flatnonzero(~alone)
                yield _bucketed(cols, keep, base + heads)
                head = int(heads[-1])
            else:
                head = done if new[0] else head
            done += len(new) - 1
            last = [c[-1] for c in cols]
        if last is not None and head != done:
            yield _bucketed([np.array([x]) for x in last], np.array([0]), np.array([base + head]))

    return suffixes.repartition("b", "later").sortWithinPartitions("b", "later", "c", "p").mapInArrow(run, BUCKETS)


def _bucketed(cols: list[np.ndarray], keep: np.ndarray, heads: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[2][keep].astype(np.int64)), pa.array(cols[3][keep].astype(np.int32)), pa.array(heads[keep].astype(np.int64))], names=["c", "p", "b"])


def pointers(buckets: DataFrame, offset: int) -> DataFrame:
    """(b, later, c, p): each suffix (c, p, b) with the bucket of the suffix ``offset`` tokens later; where that one is alone, so is this."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, p, b in streamed(batches, 1, ROWS_AT_ONCE):
            place = (np.cumsum(changes([c])) << 32) + p
            at = np.searchsorted(place, place + offset)
            ok = np.flatnonzero(np.append(place, -1)[at] == place + offset)
            yield pa.RecordBatch.from_arrays([pa.array(b[ok]), pa.array(b[at[ok]]), pa.array(c[ok]), pa.array(p[ok].astype(np.int32))], names=["b", "later", "c", "p"])

    return buckets.repartition("c").sortWithinPartitions("c", "p").mapInArrow(run, SUFFIXES)


def window_classes(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """(c, p, b): windows of the contexts that are equal to another window of these contexts, and their classes."""
    buckets = refine(initial_buckets(rows, contexts))
    for offset in OFFSETS[1:]:
        buckets = refine(pointers(buckets, offset))
    return buckets


def _runs(windows: DataFrame) -> DataFrame:
    """(c, i, j, b): runs of neighbouring windows (c, p, b) and the class of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, p, b in streamed(batches, 1, ROWS_AT_ONCE):
            i, j = ranges(c, p)
            yield pa.RecordBatch.from_arrays([pa.array(c[i]), pa.array(p[i].astype(np.int32)), pa.array(p[j].astype(np.int32)), pa.array(b[i])], names=["c", "i", "j", "b"])

    return windows.repartition("c").sortWithinPartitions("c", "p").mapInArrow(run, "c long, i int, j int, b long")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_words, first_doc, copies) of every stretch of 50-token windows that occur at two places or more.

    ``start`` counts tokens from 0, ``first_doc`` is the smallest doc_id that has the first window of
    the stretch, ``copies`` the number of its occurrences; the first occurrence is reported like the others.  Defined
    cases: texts that are null, empty or shorter than a window, and rows without doc_id, hold no
    window; very long texts are read whole; repeated rows are one document, rows that share a doc_id but not the text
    are texts of their own; of equal windows none comes before the other but by doc_id; no documents give no rows; other columns play no part.
    """
    rows = rows_of(docs)
    found = occurrences(rows)
    one_key = Window.partitionBy("key")
    each = found.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc0"))
    each = each.withColumn("all", F.sum("n").over(one_key)).withColumn("others", F.count(F.lit(1)).over(one_key) - 1)
    contexts = settle(each.where("all > 1").drop("all").withColumn("c", F.monotonically_increasing_id()))

    of_c = contexts.select("c", "n", "doc0")
    windows = settle(window_classes(rows, contexts.where("others > 0")).join(of_c, "c"))
    classes = windows.groupBy("b").agg(F.sum("n").alias("copies"), F.min("doc0").alias("first_doc"))
    runs = _runs(windows.where("n = 1").select("c", "p", "b"))
    heads = windows.where("n > 1 and p = 0").select("c", F.lit(0).alias("i"), F.lit(ALL).alias("j"), "b")
    told = runs.unionByName(heads).join(classes, "b").select("c", "i", "j", "copies", "first_doc")
    # a context that occurs twice is repeated as a whole, by itself if no class of its first window says more
    whole = contexts.where("n > 1").join(heads.select("c"), "c", "left_anti").select("c", F.lit(0).alias("i"), F.lit(ALL).alias("j"), F.col("n").alias("copies"), F.col("doc0").alias("first_doc"))
    answers = settle(told.unionByName(whole).join(contexts.select("c", "key", "ctx"), "c").drop("c"))
    stretches = found.join(small(answers, answers.count(), 48), ["key", "ctx"])
    stretches = stretches.select("doc_id", "th", (F.col("lo") + F.col("i")).alias("s"), F.least("hi", F.col("lo").cast("long") + F.col("j")).cast("int").alias("e"), "first_doc", "copies")
    return spans(stretches, "first_doc", "copies").select("doc_id", "start", "n_words", "first_doc", "copies")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\f\r]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS g FROM p),
c AS (SELECT *, count(*) OVER (PARTITION BY g) AS copies, min(doc_id) OVER (PARTITION BY g) AS first_doc FROM g),
r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c WHERE copies > 1)
SELECT doc_id, CAST(min(p) - 1 AS INTEGER) AS start, CAST(count(*) + 49 AS INTEGER) AS n_words,
       arg_min(first_doc, p) AS first_doc, arg_min(copies, p) AS copies
FROM r GROUP BY doc_id, run
"""
