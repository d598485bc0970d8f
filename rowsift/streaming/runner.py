"""Row-wise plans over a stream of NDJSON lines; time buckets and first-occurrence filters with watermarks as extensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import QueryError
from ..functions import timeattr
from ..operators.frame import Frame
from ..operators.lower import lower
from ..plans.nodes import CountByTime, Dedup, Limit, Plan
from ..plans.normalize import is_streamable
from ..sources.readers import BLANKS, ndjson_columns


def lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """A folder of text files that grows."""
    return spark.readStream.options(lineSep="\n", **options).text(path)


def frame_of(stream: DataFrame) -> Frame:
    """Records of a stream with a text column ``value``; corrupt and blank lines are left out."""
    rows = stream.select(F.btrim("value", F.lit(BLANKS)).alias("value")).where("value != ''")
    fields, corrupt = ndjson_columns(F.col("value"))
    return Frame(rows.where(~corrupt).select(fields.alias("fields"), F.col("value").alias("_raw")), dynamic=True)


def transform(plan: Plan, stream: DataFrame, strict: bool = False) -> DataFrame:
    """The streaming DataFrame of a row-wise plan; its limit, if any, is up to ``start``."""
    if not is_streamable(plan):
        raise QueryError("only filters, projections, casts and per-row functions can stream")
    nodes = tuple(n for n in plan.nodes if not isinstance(n, Limit))
    return lower(Plan(plan.layer, nodes, case_sensitive=plan.case_sensitive), frame_of(stream), strict).df


def start(plan: Plan, stream: DataFrame, emit: Callable[[list[str]], None], checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Emits each batch's records as JSON lines and ends the query once the limit is reached."""
    limits = [n.n for n in plan.nodes if isinstance(n, Limit)]
    left = [min(limits)] if limits else None
    out = transform(plan, stream).select(F.to_json("fields").alias("json"))
    query: list[StreamingQuery] = []

    def batch(df: DataFrame, _epoch: int) -> None:
        if left is not None:
            df = df.limit(left[0])
        rows = [r.json for r in df.toLocalIterator()]
        if left is not None:
            left[0] -= len(rows)
        if rows:
            emit(rows)
        if left is not None and left[0] <= 0 and query:
            query[0].stop()

    writer = out.writeStream.foreachBatch(batch).outputMode("append")
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query.append(writer.trigger(**(trigger or {"availableNow": True})).start())
    return query[0]


def bucket_counts(node: CountByTime, frame: Frame, lateness: str = "10 minutes") -> DataFrame:
    """(bucket, count) per closed window of fixed length; late rows beyond ``lateness`` are dropped."""
    secs = timeattr.seconds_of(node.bucket)
    if secs is None:
        raise QueryError("a stream is bucketed by a fixed length such as 5m")
    ts = frame.df.select(F.timestamp_seconds(frame.value(node.path).epoch).alias("at")).where("at is not null")
    grouped = ts.withWatermark("at", lateness).groupBy(F.window("at", f"{secs} seconds")).agg(F.count(F.lit(1)).alias("count"))
    return grouped.select(F.date_format("window.start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("bucket"), "count")


def first_seen(node: Dedup, frame: Frame, time_path: str, lateness: str = "10 minutes") -> DataFrame:
    """One record per value of a field within the watermark."""
    keyed = frame.df.withColumns({"__key": F.coalesce(frame.value(node.path).text, F.lit("")), "__at": F.timestamp_seconds(frame.value(time_path).epoch)})
    return keyed.where("__at is not null").withWatermark("__at", lateness).dropDuplicatesWithinWatermark(["__key"]).drop("__key", "__at")
