"""Substring deduplication on a log-structured fingerprint index.

The index holds the contexts of historical windows (see passages), each where it occurs first, under the hash of its anchor.  It
is a list of immutable runs, each a Parquet table of as many files by hash of the anchor as the session had shuffle partitions when the index was made, every file sorted; a manifest names the runs, so an
index can be closed and opened again.  A new batch is fingerprinted, distributed into the same buckets and merge-joined with each run
bucket by bucket; no run is ever shuffled.  Contexts that the index lacks become a run of level 0, and when a level has ``FANOUT`` runs they are
merged, again bucket by bucket, into one of the next level.

Matches only say where to look.  A context that is known is repeated as a whole; where contexts differ under one anchor their windows
are read again from the texts, of history only from documents that the index names, and compared.  Every stretch so found is verified: the
tokens of its first window are cut from both texts and compared as text.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remove, scratch, settle, small, table
from .passages import ALL, WINDOW, Windows, changes, occurrences, ranges, rows_of, spans, streamed, wanted
from .textkit import ragged_take, run_hashes, signed, slices

FANOUT = 2
BATCHES = 3
ROWS_AT_ONCE = 200_000
ENTRY = "key long, ctx long, doc_id long, th int, lo int"


class FingerprintIndex:
    """Runs in a folder that all executors share; a folder that has a manifest already is opened as it is."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or scratch(spark, "fingerprints")
        self.buckets, self.written = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), 0
        self.runs: list[tuple[int, str]] = []
        self._tables: dict[str, str] = {}
        said = self._manifests()
        if said:
            state = json.loads(self._read(said[-1]))
            self.buckets, self.written = state["buckets"], state["written"]
            self.runs = [(level, name) for level, name in state["runs"]]

    # ── Files ──

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _manifests(self) -> list[str]:
        _, fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        return sorted(n for n in (f.getPath().getName() for f in fs.listStatus(path(self.path))) if n.startswith("manifest-") and n.endswith(".json"))

    def _read(self, name: str) -> str:
        jvm, fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/{name}"))
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commit(self, runs: list[tuple[int, str]]) -> None:
        """Makes these the runs of the index: the manifest is written aside and renamed, then what it no longer names is removed."""
        _, fs, path = self._fs()
        old, gone = self._manifests(), {n for _, n in self.runs} - {n for _, n in runs}
        name = f"manifest-{self.written:08d}.json"
        out = fs.create(path(f"{self.path}/{name}.tmp"), True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "written": self.written, "runs": runs}).encode()))
        out.close()
        fs.delete(path(f"{self.path}/{name}"), True)
        fs.rename(path(f"{self.path}/{name}.tmp"), path(f"{self.path}/{name}"))
        self.runs = runs
        for n in old:
            if n != name:
                fs.delete(path(f"{self.path}/{n}"), False)
        for n in gone:
            self._forget(n)
            remove(self.spark, f"{self.path}/{n}")

    def _forget(self, name: str) -> None:
        if name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(name)}")

    def close(self) -> None:
        """Forgets the session's tables of the runs; the folder stays."""
        for name in list(self._tables):
            self._forget(name)

    def drop(self) -> None:
        self.close()
        remove(self.spark, self.path)

    # ── Runs ──

    def _run(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = f"fingerprints_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self._tables[name]} ({ENTRY}) USING parquet CLUSTERED BY (key) SORTED BY (key, ctx) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(self._tables[name])

    def _write(self, entries: DataFrame) -> str:
        """A new run; the entries are in buckets already, so they are only sorted and written where they lie."""
        self.written += 1
        name = f"run-{self.written:06d}"
        self._tables[name] = f"fingerprints_{uuid.uuid4().hex}"
        entries.write.bucketBy(self.buckets, "key").sortBy("key", "ctx").option("path", f"{self.path}/{name}").saveAsTable(self._tables[name])
        return name

    def entries(self) -> DataFrame | None:
        """All indexed contexts, in buckets."""
        return reduce(DataFrame.unionByName, (self._run(name) for _, name in self.runs)) if self.runs else None

    def compact(self) -> None:
        """Merges the runs of a level that has FANOUT of them, level by level."""
        level = 0
        while any(at >= level for at, _ in self.runs):
            names = [n for at, n in self.runs if at == level]
            if len(names) >= FANOUT:
                self._commit([*(r for r in self.runs if r[0] != level), (level + 1, self._write(self._merged(names)))])
            level += 1

    def _merged(self, names: list[str]) -> DataFrame:
        """The entries of several runs; a context is in one run only, so grouping by it merges them, and as they share their buckets nothing moves."""
        both = reduce(DataFrame.unionByName, (self._run(n) for n in names))
        return both.groupBy("key", "ctx").agg(F.min("doc_id").alias("doc_id"), F.min("th").alias("th"), F.min("lo").alias("lo"))

    # ── Batches ──

    def matching(self, keys: DataFrame) -> DataFrame:
        """The entries under these distinct keys, by a merge join with each run."""
        none = self.spark.createDataFrame([], ENTRY)
        return reduce(DataFrame.unionByName, (self._run(name).join(keys.hint("merge"), "key", "left_semi") for _, name in self.runs), none)

    def ingest(self, batch: DataFrame, history: DataFrame, since: int) -> DataFrame:
        """Stretches (doc_id, th, start, n_words, first_doc) of the batch that occur before; then indexes the batch.

        The batch has the doc_ids from ``since`` on, the history those below; both are rows_of documents.
        """
        found = occurrences(batch)
        place = F.struct("doc_id", "th", "lo")
        fresh = settle(found.repartition(self.buckets, "key").groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")).select("key", "ctx", "n", "at.*"))
        known = settle(self.matching(fresh.select("key").distinct()))
        seen = known.select("key", "ctx", F.lit(True).alias("seen"))
        new = fresh.join(seen, ["key", "ctx"], "left_anti")
        one_key = Window.partitionBy("key")
        both = known.withColumn("n", F.lit(2)).withColumn("old", F.lit(True)).unionByName(new.withColumn("old", F.lit(False)))
        each = both.withColumn("others", F.count(F.lit(1)).over(one_key) - 1)
        # a new context that occurs once, under an anchor of its own, repeats nothing
        contexts = settle(each.where("old or others > 0 or n > 1").withColumn("c", F.monotonically_increasing_id()))
        windows = settle(_windows(_asked(batch, history, contexts, since)))
        answers = _answers(contexts, windows)
        # the first occurrence of a context is told by its own windows, every other one as a whole
        first = (F.col("doc_id") == F.col("doc0")) & (F.col("th") == F.col("th0")) & (F.col("lo") == F.col("lo0"))
        met = found.join(small(answers, answers.count(), 80), ["key", "ctx"]).where(first == F.col("own"))
        stretches = met.select("doc_id", "th", (F.col("lo") + F.col("i")).alias("s"), F.least("hi", F.col("lo").cast("long") + F.col("j")).cast("int").alias("e"), "first_doc", "first_th", "first_pos")
        told = _verified(spans(stretches, "first_doc", "first_th", "first_pos"), batch, history, since)
        entries = new.select("key", "ctx", "doc_id", "th", "lo").repartition(self.buckets, "key")
        self._commit([*self.runs, (0, self._write(entries))])
        self.compact()
        return told


def _near(history: DataFrame, docs: DataFrame, column: str, since: int) -> DataFrame:
    """Rows of history among these documents; the bounds of their ids reach the scan."""
    low, high = docs.where(F.col(column) < since).agg(F.min(column), F.max(column)).first()
    return history.where(F.lit(False)) if low is None else history.where(F.col("doc_id").between(low, high))


def _asked(batch: DataFrame, history: DataFrame, contexts: DataFrame, since: int) -> DataFrame:
    """Texts with the contexts to be read from each: those that differ from another one under their anchor, where they occur first."""
    asked = settle(contexts.where("others > 0").groupBy(F.col("doc_id").alias("in_doc"), F.col("th").alias("in_th")).agg(F.collect_list(F.struct("key", "ctx", "c")).alias("asked")))
    n, m = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("asked")), F.lit(0))).first()
    texts = batch.unionByName(_near(history, asked, "in_doc", since))
    return texts.join(small(asked, 1, 40 * n + 32 * m), (F.col("doc_id") == F.col("in_doc")) & (F.col("th") == F.col("in_th"))).select("text", "asked", "doc_id", "th")


def _windows(texts: DataFrame) -> DataFrame:
    """(c, p, first_doc, first_th, first_pos): windows that occur before in another context, and where; and the first window of each."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Windows(part.column(0))
                which, c = wanted(w, part.column(1))
                size = w.hi[which] - w.lo[which] + 1
                p = ragged_take(np.arange(int(size.max()) if len(size) else 0), np.zeros(len(size), dtype=np.int64), size)
                at, row = np.repeat(w.lo[which], size) + p, pa.array(np.repeat(w.row[which], size))
                half = at + WINDOW // 2
                cols = [pa.array(signed(run_hashes(w.h, at, half))), pa.array(signed(run_hashes(w.h, half, at + WINDOW))), part.column(2).take(row), part.column(3).take(row), pa.array((at - np.repeat(w.base[which], size)).astype(np.int32)), pa.array(np.repeat(c, size)), pa.array(p.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "doc_id", "th", "pos", "c", "p"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # where the class that is open occurs first
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([[x], c]) for x, c in zip(held, cols, strict=True)]
            heads = np.maximum.accumulate(np.where(changes(cols[:2]), np.arange(len(cols[0])), 0))
            keep = (heads < np.arange(len(heads))) | (cols[6] == 0)
            keep[0] &= held is None
            at, h = np.flatnonzero(keep), heads[keep]
            kinds = (np.int64, np.int32, np.int64, np.int32, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip((cols[5][at], cols[6][at], cols[2][h], cols[3][h], cols[4][h]), kinds, strict=True)], names=["c", "p", "first_doc", "first_th", "first_pos"])
            held = [c[heads[-1]] for c in cols]

    rows = texts.mapInArrow(named, "a long, b long, doc_id long, th int, pos int, c long, p int")
    ordered = rows.repartition("a", "b").sortWithinPartitions("a", "b", "doc_id", "th", "pos")
    return ordered.mapInArrow(first, "c long, p int, first_doc long, first_th int, first_pos int")


def _answers(contexts: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, ctx, doc0, th0, lo0, own, i, j, first_doc, first_th, first_pos): what is repeated of a context.

    ``own`` answers are for its first occurrence, if that is in the batch; the others say that it is repeated as a whole.
    """
    places = contexts.select("c", "key", "ctx", "old", F.col("doc_id").alias("doc0"), F.col("th").alias("th0"), F.col("lo").alias("lo0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, p, *where in streamed(batches, 1, ROWS_AT_ONCE):
            i, j = ranges(c, p)
            yield pa.RecordBatch.from_arrays([pa.array(c[i]), pa.array(p[i]), pa.array(p[j]), *(pa.array(x[i]) for x in where)], names=["c", "i", "j", "first_doc", "first_th", "first_pos"])

    at = places.join(windows, "c")
    earlier = (F.col("first_doc") != F.col("doc0")) | (F.col("first_th") != F.col("th0")) | (F.col("first_pos") != F.col("lo0") + F.col("p"))
    own = at.where(earlier & ~F.col("old")).select("c", "p", "first_doc", "first_th", "first_pos").repartition("c").sortWithinPartitions("c", "p")
    own = own.mapInArrow(run, "c long, i int, j int, first_doc long, first_th int, first_pos int")
    heads = windows.where("p = 0").select("c", "first_doc", "first_th", "first_pos")
    whole = places.join(heads, "c", "left").select(
        "key", "ctx", "doc0", "th0", "lo0", F.lit(False).alias("own"), F.lit(0).alias("i"), F.lit(ALL).alias("j"), F.coalesce("first_doc", "doc0").alias("first_doc"), F.coalesce("first_th", "th0").alias("first_th"), F.coalesce("first_pos", "lo0").alias("first_pos")
    )
    mine = places.join(own, "c").select("key", "ctx", "doc0", "th0", "lo0", F.lit(True).alias("own"), "i", "j", "first_doc", "first_th", "first_pos")
    return settle(whole.unionByName(mine))


def _verified(stretches: DataFrame, batch: DataFrame, history: DataFrame, since: int) -> DataFrame:
    """The stretches whose first window reads the same, token by token, where it is said to occur first."""
    ids = settle(stretches.withColumn("id", F.monotonically_increasing_id()))
    n = ids.count()

    def cuts(texts: DataFrame, doc: str, th: str, pos: str, name: str) -> DataFrame:
        asked = ids.groupBy(F.col(doc).alias("in_doc"), F.col(th).alias("in_th")).agg(F.collect_list(F.struct("id", F.col(pos).alias("pos"))).alias("asked"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in slices(b):
                    tok = Windows(part.column(0)).tok
                    lists = part.column(1)
                    row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                    flat = lists.flatten()
                    first = tok.bounds[row] + flat.field("pos").to_numpy()
                    said = [b" ".join(tok.buf[a:z].tobytes() for a, z in zip(tok.start[i : i + WINDOW].tolist(), tok.end[i : i + WINDOW].tolist(), strict=True)) for i in first.tolist()]
                    yield pa.RecordBatch.from_arrays([flat.field("id"), pa.array(said, pa.binary())], names=[f"{name}_id", name])

        joined = texts.join(small(asked, 1, 24 * n + 24 * n), (F.col("doc_id") == F.col("in_doc")) & (F.col("th") == F.col("in_th"))).select("text", "asked")
        return joined.mapInArrow(run, f"{name}_id long, {name} binary")

    here = cuts(batch, "doc_id", "th", "start", "here")
    there = cuts(batch.unionByName(_near(history, ids, "first_doc", since)), "first_doc", "first_th", "first_pos", "there")
    same = here.join(there, F.col("here_id") == F.col("there_id")).where("here = there").select("here_id")
    return settle(ids.join(same, F.col("id") == F.col("here_id"), "left_semi").select("doc_id", "th", "start", "n_words", "first_doc"))


def incremental_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, start, n_words, first_doc) of every stretch of 50-token windows that occur before.

    Before means in a smaller doc_id or earlier in the same document; documents arrive in ``batches`` equal ranges
    of doc_id, and the result is the same for any number of them.  ``first_doc`` is the document in which the
    first window of the stretch occurs first.  Defined cases: texts that are null, empty or shorter than a
    window, and rows without doc_id, hold no window; very long texts are read whole; repeated rows are one document; rows
    that share a doc_id but not the text are texts of their own, in some fixed order; no documents give no rows;
    other columns play no part.
    """
    spark, rows = docs.sparkSession, rows_of(docs)
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    index, out = FingerprintIndex(spark), []
    if low is None:
        low, high, batches = 0, 0, 1
    edges = sorted({low + (high - low + 1) * i // batches for i in range(batches)}) + [high + 1]
    for a, z in zip(edges, edges[1:], strict=False):
        batch = rows.where((F.col("doc_id") >= a) & (F.col("doc_id") < z))
        out.append(index.ingest(batch, rows.where(F.col("doc_id") < a), a))
    index.drop()
    return reduce(DataFrame.unionByName, out).select("doc_id", "start", "n_words", "first_doc")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\f\r]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS g FROM p),
c AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS nth, min(doc_id) OVER (PARTITION BY g) AS first_doc FROM g),
r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c WHERE nth > 1)
SELECT doc_id, CAST(min(p) - 1 AS INTEGER) AS start, CAST(count(*) + 49 AS INTEGER) AS n_words, arg_min(first_doc, p) AS first_doc
FROM r GROUP BY doc_id, run
"""
