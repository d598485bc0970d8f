"""Benchmark decontamination by winnowing.

Both sides keep the smallest k-gram hash of every window of w neighbouring k-grams, so any span
of at least k + w - 1 shared words shares a fingerprint.  The fingerprints are joined, and
every hit is extended word by word along its diagonal to the maximal run of equal words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_ids, fresh, settle, small, table
from .textkit import ALNUM, Tokens, gram_hashes, signed, slices, text_buffers, window_minima, window_starts

K, W = 8, 6


def fingerprints(rows: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """(id, pos, h) of the winnowed k-grams of rows (id, text), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                tok = Tokens(*text_buffers(part.column(1), lower=True), ALNUM)
                grams = gram_hashes(tok.hashes(), k)
                at = window_starts(tok.bounds, k + w - 1)
                chosen = window_minima(grams, w)[at] if len(at) else at
                chosen = np.unique(chosen)
                doc = np.searchsorted(tok.bounds, chosen, "right") - 1
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc], pa.int64()), pa.array((chosen - tok.bounds[doc]).astype(np.int32)), pa.array(signed(grams[chosen]))], names=["id", "pos", "h"])

    return rows.mapInArrow(run, "id long, pos int, h long")


def _words(rows: DataFrame) -> DataFrame:
    """(item_id, words) as word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                tok = Tokens(*text_buffers(part.column(1), lower=True), ALNUM)
                lists = pa.ListArray.from_arrays(pa.array(tok.bounds.astype(np.int32)), pa.array(signed(tok.hashes())))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["item_id", "words"])

    return rows.mapInArrow(run, "item_id long, words array<long>")


RUNS = "doc_id long, item_id long, doc_start int, item_start int, n_words int"


def shared_spans(docs: DataFrame, benchmark: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words): maximal runs of k+w-1 or more equal words.

    Words are runs of ASCII letters, digits and non-ASCII characters in lower case; starts count
    words from 0.  Every such run is found, however often it occurs.  Defined cases: a null or
    empty text shares nothing; very long texts are compared whole; rows without doc_id or item_id are passed over; repeated rows
    give their runs once; rows that share an id contribute the runs of each text; an
    empty table on either side gives no rows; other columns play no part.
    """
    least = k + w - 1
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")
    b = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null").distinct()
    items = settle(_words(b))
    size = items.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    lengths = items.groupBy("item_id").agg(F.max(F.size("words")).alias("length"))
    marks = fingerprints(b, k, w).select(F.col("id").alias("item_id"), F.col("pos").alias("ipos"), "h").distinct().join(small(lengths, size[0], 20), "item_id")
    found = fingerprints(d, k, w).join(small(marks, size[1], 40), "h")
    hits = settle(found.groupBy("id").agg(F.collect_set(F.struct("item_id", (F.col("pos") - F.col("ipos")).alias("diag"), "length")).alias("hits")))
    n = hits.agg(F.count("*"), F.coalesce(F.sum(F.size("hits")), F.lit(0))).first()
    hits = hits.withColumnRenamed("id", "hit_id")
    seeds = d.join(small(hits, n[1] + n[0], 48), F.col("id") == F.col("hit_id")).select("id", "text", "hits")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                tok = Tokens(*text_buffers(part.column(1), lower=True), ALNUM)
                h, out = signed(tok.hashes()), []
                for i, (doc, seeds_of) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    lo, hi = tok.bounds[i], tok.bounds[i + 1]
                    for s in seeds_of:
                        a = max(0, s["diag"])
                        z = min(hi - lo, s["diag"] + s["length"])
                        if z - a >= least:
                            out.append((doc, s["item_id"], s["diag"], a, h[lo + a : lo + z]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=["doc_id", "item_id", "diag", "first", "part"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                x = np.array(r["part"], dtype=np.int64)
                y = np.array(r["words"], dtype=np.int64)[r["first"] - r["diag"] :][: len(x)]
                same = np.concatenate([[False], x[: len(y)] == y, [False]])
                edge = np.flatnonzero(same[1:] != same[:-1])
                for a, z in zip(edge[::2], edge[1::2], strict=True):
                    if z - a >= least:
                        at = r["first"] + int(a)
                        rows.append((r["doc_id"], r["item_id"], at, at - r["diag"], int(z - a)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), *[pa.int32()] * 3), strict=True)], names=["doc_id", "item_id", "doc_start", "item_start", "n_words"])

    parts = seeds.mapInArrow(cut, "doc_id long, item_id long, diag int, first int, part array<long>")
    return parts.join(small(items, size[1], 8), "item_id").select("doc_id", "item_id", "diag", "first", "part", "words").mapInArrow(extend, RUNS).distinct()


def clean(docs: DataFrame, benchmark: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """The documents that share no span of k+w-1 words with a benchmark item, in the columns they have.

    Every row is judged by its own text, under a hash of text and doc_id, so rows without an id and rows that share one with other texts are
    told apart.  Defined cases: null and empty texts stay; repeated rows stay or go together; a span of exactly k+w-1 words is enough;
    texts are read whole, however long; an empty benchmark leaves all, no documents give none.
    """
    (held,) = fresh(docs, "__id")
    told = docs.withColumn(held, F.col("doc_id")).withColumn("doc_id", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    bad = settle(shared_spans(told, benchmark, k, w).select("doc_id").distinct())
    return drop_ids(told, small(bad, bad.count(), 16)).withColumn("doc_id", F.col(held)).drop(held)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13),
bp AS (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS q FROM b WHERE len(w) >= 13),
dg AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM dp),
bg AS (SELECT item_id, q, array_to_string(w[q:q + 12], ' ') AS g FROM bp),
hit AS (SELECT DISTINCT doc_id, item_id, p, q FROM dg JOIN bg USING (g)),
runs AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS run FROM hit)
SELECT doc_id, item_id, CAST(min(p) - 1 AS INTEGER) AS doc_start, CAST(min(q) - 1 AS INTEGER) AS item_start,
       CAST(count(*) + 12 AS INTEGER) AS n_words
FROM runs GROUP BY doc_id, item_id, p - q, run
"""
