"""Minimax contiguous partition of ordered atomic groups into shards.

The smallest capacity under which the groups, in their order, fit into at most K shards lies between the larger of
total/K and the largest group, and that plus the largest group.  A binary search over capacities checks each one greedily: a shard takes
groups until the next would not fit.  The check jumps from cut to cut over prefix sums.

The prefix sums stay distributed.  The driver holds them at ``COARSE`` places at most: first at even distances, which bounds every cut from
below and above and with it the capacity; then, closer and closer, only where cuts can lie under the capacities left, until each of them
is known exactly.  So the driver's memory doesn't grow with the groups, and the search is the same at every size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, small, table

SHARDS = 64
#: Consecutive doc_ids of a source that stay together.
BLOCK = 256
#: Prefix sums fetched at once.
COARSE = 500_000


class Prefix:
    """Prefix sums at some places: ``at`` counts the groups before a place, from 0 to all of them, ``total`` their size."""

    def __init__(self, at: np.ndarray, total: np.ndarray):
        self.at, first = np.unique(at, return_index=True)
        self.total = total[first]

    def merged(self, at: np.ndarray, total: np.ndarray) -> Prefix:
        return Prefix(np.concatenate([self.at, at]), np.concatenate([self.total, total]))

    def cuts(self, capacity: int, most: int, late: bool) -> tuple[list[int], bool]:
        """Indices of the greedy cuts, the end among them; a cut between known places counts as the one before, or behind if ``late``.

        False if they stop short of the end: ``most`` shards are not enough, or a shard can't be told from an empty one.
        """
        out, i, last = [], 0, len(self.at) - 1
        while i < last:
            j = int(np.searchsorted(self.total, self.total[i] + capacity, "right")) - 1
            if late and j < last and self.at[j + 1] - self.at[j] > 1:
                j += 1
            if j <= i or len(out) == most:
                return out, False
            out.append(j)
            i = j
        return out, True

    def smallest(self, low: int, high: int, shards: int, late: bool) -> int:
        """Smallest capacity from low to high that fits by this reading; high if none below it does."""
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, late)[1]:
                high = mid
            else:
                low = mid + 1
        return low


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The answer for sizes at hand."""
    if not len(sizes):
        return 0
    prefix = Prefix(np.arange(len(sizes) + 1), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
    low = max(int(np.max(sizes)), -(-int(prefix.total[-1]) // shards))
    return prefix.smallest(low, low + int(np.max(sizes)), shards, False)


def search(ranked: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(capacity, first group of each shard) of groups (ord, size, upto)."""
    n, total, most = ranked.agg(F.count("*"), F.sum("size"), F.max("size")).first()

    def fetch(where: Column, step: int) -> tuple[np.ndarray, np.ndarray]:
        got = ranked.where(where & ((F.col("ord") + 1) % step == 0)).select((F.col("ord") + 1).alias("at"), "upto").toArrow()
        return got["at"].to_numpy().astype(np.int64), got["upto"].to_numpy().astype(np.int64)

    ends = np.array([0, n]), np.array([0, total])
    prefix = Prefix(*ends).merged(*fetch(F.lit(True), -(-n // COARSE)))
    low = max(most, -(-total // shards))
    high = low + most
    while True:
        low, high = prefix.smallest(low, high, shards, True), prefix.smallest(low, high, shards, False)
        early, whole = prefix.cuts(low, shards, False)
        late, _ = prefix.cuts(high, shards, True)
        if low == high and whole and early == late:
            return int(low), [0, *(int(prefix.at[j]) for j in early[:-1])]
        # the k-th cut lies between the k-th early one under the lowest capacity and the k-th late one under the highest
        at, inside = prefix.at, np.zeros(len(prefix.at), dtype=bool)
        for k, z in enumerate(late):
            inside[early[min(k, len(early) - 1)] if early else 0 : z + 1] = True
        wide = np.diff(at)
        gaps = np.flatnonzero((wide > 1) & inside[:-1])
        runs = np.split(gaps, np.flatnonzero(np.diff(gaps) > 1) + 1)
        rows = int(sum(at[r[-1] + 1] - at[r[0]] for r in runs))
        where = F.lit(False)
        for r in runs:
            where = where | F.col("ord").between(int(at[r[0]]), int(at[r[-1] + 1]) - 2)
        prefix = prefix.merged(*fetch(where, max(1, min(-(-rows // COARSE), int(wide[gaps].max()) // 2))))


def _groups(docs: DataFrame, block: int) -> list[Column]:
    return [F.col("source").cast("string").alias("source"), block_of(F.col("doc_id"), block).alias("block")]


def block_of(doc_id: Column, block: int) -> Column:
    """floor(doc_id / block) in whole numbers."""
    i = doc_id.cast("long")
    down = F.when(i % block < 0, 1).otherwise(0)
    return F.call_function("div", i, F.lit(block)) - down


def _solved(docs: DataFrame, shards: int, block: int) -> tuple[DataFrame, int, list[int]]:
    d = docs.select(*_groups(docs, block), F.coalesce(F.char_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("size"))
    groups = settle(d.groupBy("source", "block").agg(F.count("*").alias("docs"), F.sum("size").alias("size")))
    ranked = _with_prefix(groups)
    capacity, first = search(ranked, shards) if not groups.isEmpty() else (0, [0])
    return ranked, capacity, first


def plan(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """(source, block, docs, size, shard, capacity), one row a group.

    A group is the rows of one source in one run of ``block`` doc_ids; groups are ordered by source, then by block; its size is its
    number of characters.  Defined cases: a null source, and within a source a null doc_id, come
    first and form groups of their own; null texts count as 0 characters, and groups of size 0 go with the shard that is
    open; a very long text counts whole and may fill a shard of its own; repeated rows count each time; groups of equal
    size are told apart by their order alone; no documents give no rows; other columns play no part.
    """
    ranked, capacity, first = _solved(docs, shards, block)
    bounds = F.array(*(F.lit(int(c)).cast("long") for c in first))
    shard = F.size(F.filter(bounds, lambda b: b <= F.col("ord"))) - 1
    return ranked.select("source", "block", "docs", "size", shard.alias("shard"), F.lit(int(capacity)).cast("long").alias("capacity"))


def _with_prefix(groups: DataFrame) -> DataFrame:
    """Adds ``ord``, from 0, and ``upto``, the sum of sizes up to and with the group, by a range sort and one offset per partition."""
    spark = groups.sparkSession
    order = [F.col("source").asc_nulls_first(), F.col("block").asc_nulls_first()]
    ranged = settle(groups.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    sums = sorted(map(tuple, ranged.groupBy("part").agg(F.count("*"), F.sum("size")).collect()))
    rows, n, s = [], 0, 0
    for part, count, size in sums:
        rows.append((part, n, s))
        n, s = n + count, s + size
    offsets = spark.createDataFrame(rows, "of_part int, n0 long, s0 long")
    w = Window.partitionBy("part").orderBy(*order)
    local = ranged.withColumn("__n", F.row_number().over(w)).withColumn("__s", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = local.join(small(offsets, len(rows), 24), F.col("part") == F.col("of_part"))
    return settle(joined.select("source", "block", "docs", "size", (F.col("n0") + F.col("__n") - 1).alias("ord"), (F.col("s0") + F.col("__s")).alias("upto")))


def _place(source: Column, block: Column) -> Column:
    """The order of groups as one comparable value: nulls come first."""
    return F.struct(source.isNotNull().cast("int").alias("a"), F.coalesce(source, F.lit("")).alias("b"), block.isNotNull().cast("int").alias("c"), F.coalesce(block, F.lit(0).cast("long")).alias("d"))


def sharded(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """The rows of docs with their shard in the column ``shard``; a column of that name is replaced.

    A row finds its shard by comparing its group with the first group of each shard, so nothing is joined or shuffled.  Defined cases are
    those of plan; other columns keep their names and values, whatever they are called.
    """
    ranked, _, first = _solved(docs, shards, block)
    heads = [(r["source"], r["block"]) for r in sorted(ranked.where(F.col("ord").isin(first)).select("ord", "source", "block").collect())]
    places = F.array(*(_place(F.lit(s).cast("string"), F.lit(b).cast("long")) for s, b in heads or [(None, None)]))
    here = _place(F.col("source").cast("string"), block_of(F.col("doc_id"), block))
    return docs.withColumn("shard", F.size(F.filter(places, lambda p: p <= here)) - 1)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE g AS (SELECT source, CAST(floor(doc_id / 256) AS BIGINT) AS block, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS size FROM documents GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (ORDER BY source, block) AS n FROM g),
l AS (SELECT list({'k': 1, 'f': size} ORDER BY n) AS items, sum(size) AS total, max(size) AS most FROM o),
s(lo, hi) AS (
  SELECT CAST(greatest(most, ceil(total / 64)) AS BIGINT), CAST(greatest(most, ceil(total / 64)) + most AS BIGINT) FROM l
  UNION ALL
  SELECT CASE WHEN fits THEN lo ELSE mid + 1 END, CASE WHEN fits THEN mid ELSE hi END
  FROM (SELECT lo, hi, (lo + hi) // 2 AS mid,
          list_reduce(items, lambda a, b: CASE WHEN a.f + b.f <= (lo + hi) // 2 THEN {'k': a.k, 'f': a.f + b.f} ELSE {'k': a.k + 1, 'f': b.f} END).k <= 64 AS fits
        FROM s, l WHERE lo < hi)),
cap AS (SELECT min(hi) AS capacity FROM s),
w(n, shard, fill) AS (
  SELECT CAST(1 AS BIGINT), 0, size FROM o WHERE n = 1
  UNION ALL
  SELECT o.n, CASE WHEN fill + size <= capacity THEN shard ELSE shard + 1 END, CASE WHEN fill + size <= capacity THEN fill + size ELSE size END
  FROM w JOIN o ON o.n = w.n + 1, cap)
SELECT source, block, docs, size, shard, capacity FROM o JOIN w USING (n), cap
"""
