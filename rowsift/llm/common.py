"""Session helpers of the operators: shared folder, lineage cuts, checked broadcasts, row filters."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it is known to be at most this large; beyond it the join shuffles.
BROADCAST_BYTES = 32_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: spark.checkpoint.dir, or one of our own on a local master."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="rowsift-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint if rows * row_bytes is within BROADCAST_BYTES, else the frame as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(docs: DataFrame) -> Column:
    """doc_id, or where it is null a hash of the whole row, beyond 2^62 so that documents with small ids come first."""
    cols = [F.col(c) for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(*cols).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that the frame doesn't have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with row_key as doc_id where there is a text, and the column that holds the given doc_id; equal rows without an id share a key."""
    (held,) = fresh(docs, "__id")
    return docs.withColumn(held, F.col("doc_id")).withColumn("doc_id", F.when(F.col("text").isNull(), F.col("doc_id").cast("long")).otherwise(row_key(docs))), held


def unkeyed(docs: DataFrame, held: str) -> DataFrame:
    return docs.withColumn("doc_id", F.col(held)).drop(held)


def text_bytes(df: DataFrame, *cols: str) -> tuple[int, int]:
    """(rows, bytes of the text columns) of a frame, for the size check of a broadcast."""
    size = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in cols), F.lit(0).cast("long"))
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first())


def drop_ids(docs: DataFrame, ids: DataFrame, col: str = "doc_id") -> DataFrame:
    """Rows of docs whose doc_id isn't among ids; rows without an id stay."""
    gone = ids.select(F.col(col).alias("__gone"))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def keep_ids(docs: DataFrame, ids: DataFrame, col: str = "doc_id") -> DataFrame:
    kept = ids.select(F.col(col).alias("__kept"))
    return docs.join(kept, docs["doc_id"] == kept["__kept"], "left_semi")
