"""Queries over the Parquet tables, each with SQL that gives the same rows."""

from __future__ import annotations

import io
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lang
from .api import Engine
from .operators.frame import Frame
from .plans.nodes import CountByTime
from .sources import readers
from .streaming import runner


class Entry(NamedTuple):
    table: str
    text: str
    sql: str
    case_sensitive: bool = False
    casts: dict | None = None


ENTRIES = {
    "kw_eq": Entry('events', 'where event_type=ERROR', "SELECT * FROM events WHERE lower(event_type)='error'"),
    "kw_eq_cs": Entry('events', 'where event_type=error', "SELECT * FROM events WHERE event_type='error'", case_sensitive=True),
    "kw_eq_int": Entry('events', 'where user_id=13', 'SELECT * FROM events WHERE user_id=13'),
    "kw_ne": Entry('events', 'where event_type!=view', "SELECT * FROM events WHERE lower(event_type)<>'view'"),
    "kw_gt": Entry('events', 'where value gt 100', 'SELECT * FROM events WHERE value>100'),
    "kw_lt": Entry('events', 'where value lt 5', 'SELECT * FROM events WHERE value<5'),
    "kw_gte": Entry('events', 'where user_id gte 50', 'SELECT * FROM events WHERE user_id>=50'),
    "kw_lte": Entry('events', 'where user_id lte 10', 'SELECT * FROM events WHERE user_id<=10'),
    "kw_between": Entry('events', 'where value between 100 200', 'SELECT * FROM events WHERE value BETWEEN 100 AND 200'),
    "kw_str_range": Entry('orders', 'where o_orderpriority gt 3-MEDIUM', "SELECT * FROM orders WHERE o_orderpriority>'3-MEDIUM'"),
    "kw_ts_range": Entry('events', 'where ts gte 2024-01-15T00:00:00Z', "SELECT * FROM events WHERE ts>=TIMESTAMP '2024-01-15'"),
    "kw_regex": Entry('part', 'where p_name~=^(cold|small)', "SELECT * FROM part WHERE regexp_matches(p_name,'^(cold|small)')"),
    "kw_contains": Entry('part', 'where p_name contains WIDGET', "SELECT * FROM part WHERE contains(lower(p_name),'widget')"),
    "kw_startswith": Entry('part', 'where p_brand startswith brand#1', "SELECT * FROM part WHERE starts_with(lower(p_brand),'brand#1')"),
    "kw_endswith": Entry('part', 'where p_brand endswith 5', "SELECT * FROM part WHERE ends_with(p_brand,'5')"),
    "kw_glob": Entry('part', 'where p_brand glob brand#?', "SELECT * FROM part WHERE p_brand ILIKE 'brand#_'"),
    "kw_exists": Entry('events', 'where props exists', 'SELECT * FROM events'),
    "kw_exists_absent": Entry('events', 'where nosuch exists', 'SELECT * FROM events WHERE false'),
    "kw_ne_absent": Entry('events', 'where nosuch!=x', 'SELECT * FROM events'),
    "kw_and_comma": Entry('events', 'where event_type=error, value gt 100', "SELECT * FROM events WHERE event_type='error' AND value>100"),
    "kw_left_assoc": Entry('events', 'where event_type=error or event_type=view and value gt 100', "SELECT * FROM events WHERE (event_type='error' OR event_type='view') AND value>100"),
    "kw_select": Entry('events', 'where event_type=purchase select event_id value', "SELECT event_id,value FROM events WHERE event_type='purchase'"),
    "kw_sort_limit": Entry('orders', 'sort o_orderkey desc limit 25', 'SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 25'),
    "kw_head": Entry('events', 'sort event_id head 10', 'SELECT * FROM events ORDER BY event_id LIMIT 10'),
    "kw_count": Entry('events', 'where event_type=error count', "SELECT count(*) AS count FROM events WHERE event_type='error'"),
    "kw_count_by": Entry('events', 'count by event_type', 'SELECT event_type, count(*) AS count FROM events GROUP BY 1'),
    "kw_count_by_int": Entry('events', 'count by user_id', 'SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS count FROM events GROUP BY 1'),
    "kw_count_by2": Entry('lineitem', 'count by l_returnflag l_linestatus', 'SELECT l_returnflag,l_linestatus,count(*) AS count FROM lineitem GROUP BY 1,2'),
    "kw_count_by_absent": Entry('events', 'count by nosuch', "SELECT '' AS nosuch, count(*) AS count FROM events"),
    "kw_count_1h": Entry('events', 'count by 1h ts', "SELECT strftime(to_timestamp(floor(epoch(ts))::BIGINT//3600*3600) AT TIME ZONE 'UTC','%Y-%m-%dT%H:%M:%SZ') AS bucket, count(*) AS count FROM events GROUP BY 1"),
    "kw_count_5m_asc": Entry('events', 'count by 5m ts asc', "SELECT strftime(to_timestamp(floor(epoch(ts))::BIGINT//300*300) AT TIME ZONE 'UTC','%Y-%m-%dT%H:%M:%SZ') AS bucket, count(*) AS count FROM events GROUP BY 1"),
    "kw_count_hour": Entry('events', 'count by hour ts', "SELECT strftime(ts,'%Y-%m-%dT%H:00:00Z') AS bucket, count(*) AS count FROM events GROUP BY 1"),
    "kw_count_day": Entry('events', 'count by day ts', "SELECT strftime(ts,'%Y-%m-%d') AS bucket, count(*) AS count FROM events GROUP BY 1"),
    "kw_count_week": Entry('lineitem', 'count by week l_shipdate', "SELECT strftime(l_shipdate,'%G-W%V') AS bucket, count(*) AS count FROM lineitem GROUP BY 1"),
    "kw_count_month": Entry('orders', 'count by month o_orderdate', "SELECT strftime(o_orderdate,'%Y-%m') AS bucket, count(*) AS count FROM orders GROUP BY 1"),
    "kw_count_year": Entry('orders', 'count by year o_orderdate', "SELECT strftime(o_orderdate,'%Y') AS bucket, count(*) AS count FROM orders GROUP BY 1"),
    "kw_count_unique": Entry('events', 'count unique user_id', 'SELECT count(DISTINCT user_id) AS count_unique FROM events'),
    "kw_count_unique_absent": Entry('events', 'count unique nosuch', 'SELECT CAST(1 AS BIGINT) AS count_unique'),
    "kw_count_types": Entry('events', 'count types value', "SELECT 'number' AS type, count(*) AS count FROM events"),
    "kw_fields": Entry('region', 'fields', "SELECT unnest(['r_name','r_regionkey']) AS field"),
    "kw_sum": Entry('events', 'sum value', 'SELECT round(sum(value),6) AS sum FROM events'),
    "kw_avg": Entry('events', 'where event_type=error avg value', "SELECT round(avg(value),6) AS avg FROM events WHERE event_type='error'"),
    "kw_min": Entry('events', 'min value', 'SELECT round(min(value),6) AS min FROM events'),
    "kw_max": Entry('lineitem', 'max l_quantity', 'SELECT round(max(l_quantity),6) AS max FROM lineitem'),
    "kw_avg_absent": Entry('events', 'avg nosuch', 'SELECT CAST(NULL AS DOUBLE) AS avg'),
    "kw_agg_ignores_limit": Entry('events', 'count by event_type limit 1', 'SELECT event_type, count(*) AS count FROM events GROUP BY 1'),
    "dsl_eq_num": Entry('events', '.user_id == 13', 'SELECT * FROM events WHERE user_id=13'),
    "dsl_ne": Entry('events', '.event_type != "view"', "SELECT * FROM events WHERE event_type<>'view'"),
    "dsl_null_eq": Entry('events', '.nosuch == null', 'SELECT * FROM events'),
    "dsl_prec": Entry('events', '.user_id == 1 or .event_type == "error" and .value > 100', "SELECT * FROM events WHERE user_id=1 OR (event_type='error' AND value>100)"),
    "dsl_not": Entry('events', 'not .event_type == "error" and .value < 50', "SELECT * FROM events WHERE NOT event_type='error' AND value<50"),
    "dsl_str_range_false": Entry('events', '.event_type > "a"', 'SELECT * FROM events WHERE false'),
    "dsl_contains": Entry('events', '.event_type contains "UR"', "SELECT * FROM events WHERE contains(lower(event_type),'ur')"),
    "dsl_matches": Entry('events', '.event_type matches "^(click|view)$"', "SELECT * FROM events WHERE regexp_matches(event_type,'^(click|view)$')"),
    "dsl_pick": Entry('events', '.value > 300 | pick(.event_id, .value)', 'SELECT event_id,value FROM events WHERE value>300'),
    "dsl_omit": Entry('events', '.value > 300 | omit(.props, .ts)', 'SELECT event_id,user_id,event_type,value FROM events WHERE value>300'),
    "dsl_count": Entry('events', '.event_type == "view" | count()', "SELECT count(*) AS count FROM events WHERE event_type='view'"),
    "dsl_sort_skip_limit": Entry('events', '| sort_by(.event_id desc) | skip(10) | limit(20)', 'SELECT * FROM events ORDER BY event_id DESC LIMIT 20 OFFSET 10'),
    "dsl_group_by2": Entry('orders', '| group_by(.o_orderstatus, .o_orderpriority)', 'SELECT o_orderstatus,o_orderpriority,count(*) AS count FROM orders GROUP BY 1,2'),
    "dsl_dedup": Entry('events', '| dedup(.user_id)', 'SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id)=1'),
    "dsl_sum": Entry('lineitem', '| sum(.l_extendedprice)', 'SELECT round(sum(l_extendedprice),6) AS sum FROM lineitem'),
    "dsl_avg_empty": Entry('events', '.value > 1e9 | avg(.value)', 'SELECT CAST(0 AS DOUBLE) AS avg'),
    "dsl_bucket": Entry('events', '| group_by_time(.ts, "1d")', "SELECT strftime(ts,'%Y-%m-%dT00:00:00Z') AS bucket, count(*) AS count FROM events GROUP BY 1"),
    "dsl_hour_group": Entry('events', '| hour_of_day(.ts) | group_by(.hour_of_day)', 'SELECT CAST(hour(ts) AS VARCHAR) AS hour_of_day, count(*) AS count FROM events GROUP BY 1'),
    "dsl_dow": Entry('events', '| day_of_week(.ts) | group_by(.day_of_week)', 'SELECT CAST(isodow(ts) AS VARCHAR) AS day_of_week, count(*) AS count FROM events GROUP BY 1'),
    "dsl_weekend": Entry('events', '| is_weekend(.ts) | group_by(.is_weekend)', "SELECT CASE WHEN isodow(ts)>=6 THEN 'true' ELSE 'false' END AS is_weekend, count(*) AS count FROM events GROUP BY 1"),
    "dsl_count_unique": Entry('part', '| count_unique(.p_brand)', 'SELECT count(DISTINCT p_brand) AS count_unique FROM part'),
    "dsl_count_unique_absent": Entry('part', '| count_unique(.nosuch)', 'SELECT CAST(0 AS BIGINT) AS count_unique'),
    "dsl_upper": Entry('part', '| to_upper(.p_name) | pick(.p_partkey, .p_name)', 'SELECT p_partkey, upper(p_name) AS p_name FROM part'),
    "dsl_replace": Entry('part', '| replace(.p_brand, "Brand#", "B") | pick(.p_partkey, .p_brand)', "SELECT p_partkey, replace(p_brand,'Brand#','B') AS p_brand FROM part"),
    "dsl_split_len": Entry('part', '| split(.p_name, " ") | map(.n = length(.p_name)) | pick(.p_partkey, .n)', "SELECT p_partkey, CAST(len(string_split(p_name,' ')) AS DOUBLE) AS n FROM part"),
    "dsl_map": Entry('lineitem', '| map(.rev = .l_extendedprice * (1 - .l_discount)) | sum(.rev)', 'SELECT round(sum(l_extendedprice*(1-l_discount)),6) AS sum FROM lineitem'),
    "dsl_map_div0": Entry('events', '| map(.r = .value / 0) | pick(.event_id)', 'SELECT event_id FROM events'),
    "cast_str": Entry('events', 'where user_id startswith 1', "SELECT event_id, ts, CAST(user_id AS VARCHAR) AS user_id, event_type, value, props FROM events WHERE starts_with(CAST(user_id AS VARCHAR),'1')", casts={'user_id': 'string'}),
    "cast_bool": Entry('labels', 'count by quality', "SELECT CASE WHEN quality<>0 THEN 'true' ELSE 'false' END AS quality, count(*) AS count FROM labels GROUP BY 1", casts={'quality': 'bool'}),
}

#: Further operators and combinations, beyond one entry an operator.
ENTRIES |= {
    "kw_or": Entry("events", "where event_type=error or user_id=13", "SELECT * FROM events WHERE event_type='error' OR user_id=13"),
    "kw_case_contains_cs": Entry("part", "where p_name contains Widget", "SELECT * FROM part WHERE contains(p_name,'Widget')", True),
    "kw_eq_double": Entry("lineitem", "where l_discount=0.05", "SELECT * FROM lineitem WHERE l_discount=0.05"),
    "kw_between_ts": Entry("orders", "where o_orderdate between 1995-01-01T00:00:00Z 1995-12-31T00:00:00Z", "SELECT * FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'"),
    "kw_mismatch_false": Entry("events", "where value gt abc", "SELECT * FROM events WHERE false"),
    "kw_count_1d_default": Entry("events", "count by 1d", "SELECT strftime(ts,'%Y-%m-%dT00:00:00Z') AS bucket, count(*) AS count FROM events GROUP BY 1"),
    "kw_count_types_text": Entry("customer", "count types c_name", "SELECT 'string' AS type, count(*) AS count FROM customer"),
    "kw_count_types_absent": Entry("nation", "count types nosuch", "SELECT 'missing' AS type, count(*) AS count FROM nation"),
    "dsl_skip": Entry("nation", "| sort_by(.n_nationkey) | skip(20)", "SELECT * FROM nation WHERE n_nationkey >= (SELECT n_nationkey FROM nation ORDER BY 1 OFFSET 20 LIMIT 1)"),
    "dsl_exists": Entry("events", ".props exists and not .nosuch exists", "SELECT * FROM events"),
    "dsl_min": Entry("orders", '.o_orderstatus == "F" | min(.o_totalprice)', "SELECT round(min(o_totalprice),6) AS min FROM orders WHERE o_orderstatus='F'"),
    "dsl_max": Entry("orders", "| max(.o_totalprice)", "SELECT round(max(o_totalprice),6) AS max FROM orders"),
    "dsl_avg": Entry("lineitem", "| avg(.l_quantity)", "SELECT round(avg(l_quantity),6) AS avg FROM lineitem"),
    "dsl_lower": Entry("part", "| to_lower(.p_brand) | group_by(.p_brand)", "SELECT lower(p_brand) AS p_brand, count(*) AS count FROM part GROUP BY 1"),
    "dsl_week": Entry("orders", '| group_by_time(.o_orderdate, "week")', "SELECT strftime(o_orderdate,'%G-W%V') AS bucket, count(*) AS count FROM orders GROUP BY 1"),
    "dsl_group_sort_limit": Entry("events", "| group_by(.user_id) | sort_by(.user_id) | limit(10)", "SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS count FROM events GROUP BY user_id ORDER BY events.user_id LIMIT 10"),
    "dsl_map_chain": Entry("events", "| map(.a = (.value + 1) * 2 - .user_id / 4) | pick(.event_id, .a)", "SELECT event_id, (value + 1) * 2 - user_id / 4 AS a FROM events"),
    "dsl_omit_many": Entry("customer", ".c_acctbal < 0 | omit(.c_name, .c_mktsegment)", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal < 0"),
    "cast_number": Entry("customer", "| sum(.c_nationkey)", "SELECT CAST(sum(c_nationkey) AS DOUBLE) AS sum FROM customer", casts={"c_nationkey": "number"}),
    "cast_null": Entry("region", "count by r_name", "SELECT 'null' AS r_name, count(*) AS count FROM region", casts={"r_name": "null"}),
}


def _records(spark: SparkSession, sf_dir: str) -> Frame:
    """The events as NDJSON lines read back as records without a schema."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "props")
    lines = rows.select(F.to_json(F.struct("*")).alias("value"), F.col("event_id").alias("_ord"), F.lit("").alias("_src_file"))
    return readers._parsed(lines, "ndjson")


#: Queries over records without a schema: the same events as JSON lines.
RECORDS = {
    "dyn_kw_count_by": ("where event_type=ERROR count by user_id", "SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS count FROM events WHERE event_type='error' GROUP BY 1"),
    "dyn_kw_between": ("where value between 100 200 count", "SELECT count(*) AS count FROM events WHERE value BETWEEN 100 AND 200"),
    "dyn_kw_bucket": ("count by 1h ts", "SELECT strftime(ts,'%Y-%m-%dT%H:00:00Z') AS bucket, count(*) AS count FROM events GROUP BY 1"),
    "dyn_kw_types": ("count types value", "SELECT 'number' AS type, count(*) AS count FROM events"),
    "dyn_kw_fields": ("fields", "SELECT unnest(['event_id','event_type','props','ts','user_id','value']) AS field"),
    "dyn_kw_unique": ("count unique user_id", "SELECT count(DISTINCT user_id) AS count_unique FROM events"),
    "dyn_kw_sum": ("where event_type=error sum value", "SELECT round(sum(value),6) AS sum FROM events WHERE event_type='error'"),
    "dyn_dsl_prec": ('.user_id == 1 or .event_type == "error" and .value > 100 | count()', "SELECT count(*) AS count FROM events WHERE user_id=1 OR (event_type='error' AND value>100)"),
    "dyn_dsl_dedup": ("| dedup(.user_id) | count()", "SELECT count(DISTINCT user_id) AS count FROM events"),
    "dyn_dsl_weekend": ("| is_weekend(.ts) | group_by(.is_weekend)", "SELECT CASE WHEN isodow(ts)>=6 THEN 'true' ELSE 'false' END AS is_weekend, count(*) AS count FROM events GROUP BY 1"),
    "dyn_dsl_map": ("| map(.x = .user_id * 2) | max(.x)", "SELECT CAST(max(user_id) * 2 AS DOUBLE) AS max FROM events"),
    "dyn_cast_bool": ("--x", "SELECT CASE WHEN user_id<>0 THEN 'true' ELSE 'false' END AS user_id, count(*) AS count FROM events GROUP BY 1"),
}


# ── Sources, sinks, streams and the command line: every query writes what it reads from the tables and reads it back ──


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors see; see the setting spark.checkpoint.dir."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="rowsift-")
    return f"{at}/formats-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.round("value", 4).alias("value"), ts)


def _cell(name: str) -> Column:
    return F.col(name).cast("string")


#: How a row of the events is written in each line format.
_LINES = {
    "ndjson": lambda: F.to_json(F.struct("*")),
    "logfmt": lambda: F.format_string('event_id=%s user_id=%s event_type="%s" value=%s ts=%s', *map(_cell, ("event_id", "user_id", "event_type", "value", "ts"))),
    "text": lambda: F.concat_ws(" | ", *map(_cell, ("event_id", "event_type", "value"))),
    "yaml": lambda: F.format_string("---\nevent_id: %s\nuser_id: %s\nevent_type: %s\nvalue: %s\nts: %s", *map(_cell, ("event_id", "user_id", "event_type", "value", "ts"))),
    "csv": lambda: F.concat_ws(",", "event_id", "user_id", F.concat(F.lit('"'), F.col("event_type"), F.lit(',"""')), _cell("value"), "ts"),
    "tsv": lambda: F.concat_ws("\t", *map(_cell, ("event_id", "user_id", "event_type", "value", "ts"))),
}
_HEADS = {"csv": "event_id,user_id,event_type,value,ts", "tsv": "event_id\tuser_id\tevent_type\tvalue\tts"}


#: Rows of one file of those that the queries write; more rows make more files, so that no task sorts, packs or parses them all.
FILE_ROWS = 500_000


def _ranges(rows: DataFrame) -> DataFrame:
    """The rows in order of event_id, a partition a file."""
    return rows.repartitionByRange(max(1, -(-rows.count() // FILE_ROWS)), "event_id").sortWithinPartitions("event_id")


def _written(spark: SparkSession, rows: DataFrame, line: Column, ending: str, head: str | None = None, packed: bool = False) -> str:
    """Files of these lines, in order of event_id, each with a first line if there is one; the path of their folder."""
    at = f"{_folder(spark)}.{ending}"
    lines = _ranges(rows).select(line.alias("value"))
    if head is not None:
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
        lines = lines.select(F.when(first, F.concat(F.lit(f"{head}\n"), "value")).otherwise(F.col("value")).alias("value"))
    lines.write.option("compression", "gzip" if packed else "none").text(at)
    return at


def _read(fmt: str, query: str, line: str | None = None, packed: bool = False, written: Callable[[DataFrame], DataFrame] = lambda df: df, sniffed: bool = True, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = written(_events(spark, sf_dir))
        head = _HEADS.get(fmt) if options.get("header", True) and options.get("sep") is None else None
        at = _written(spark, rows, _LINES[line or fmt](), fmt, head, packed)
        return Engine(spark).query(at, query, **({} if sniffed else {"fmt": fmt}), **options).df

    return run


def _json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{_folder(spark)}.json"
    _ranges(_events(spark, sf_dir)).select(F.to_json(F.struct("*")).alias("value")).mapInArrow(_as_array, "value string").write.text(at)
    return Engine(spark).query(at, "where event_type=error sum value").df


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that hold a document each as the items of one array."""
    lead = "[\n"
    for batch in batches:
        lines = []
        for text in batch.column("value").to_pylist():
            lines.append(lead + text)
            lead = ","
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"])], names=["value"])


def _toml_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{_folder(spark)}.toml"
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("all"))
    lines = F.concat(F.lit("[names]\n"), F.array_join(F.transform("all", lambda r: F.concat(F.lit("k"), r["n_nationkey"].cast("string"), F.lit(' = "'), r["n_name"], F.lit('"'))), "\n"))
    rows.select(lines.alias("value")).coalesce(1).write.text(at)
    fields = Engine(spark).query(at, "select names.k0 names.k7").frame.df.select("fields")
    return fields.select(F.explode("fields").alias("field", "v")).select("field", F.try_variant_get("v", "$", "string").alias("name"))


def _many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    a = _written(spark, rows.where("event_id % 3 = 0"), _LINES["ndjson"](), "ndjson")
    b = _written(spark, rows.where("event_id % 3 = 1"), _LINES["csv"](), "csv", _HEADS["csv"])
    c = _written(spark, rows.where("event_id % 3 = 2"), _LINES["logfmt"](), "logfmt")
    return Engine(spark).query([a, b, c], "count by user_id").df


def _line_query(line: Callable[[], Column], query: str, fmt: str = "ndjson") -> Callable[[SparkSession, str], DataFrame]:
    """A query over lines made of the events that need not stem from a JSON writer."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        at = _written(spark, _events(spark, sf_dir), line(), "log")
        return engine.query(at, query, fmt=fmt).df

    return run


def _rendered(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    """The first events as the renderer prints them, a row a line."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = Engine(spark).query(_events(spark, sf_dir), "| pick(.event_id, .event_type, .user_id) | sort_by(.event_id) | limit(20)")
        return spark.createDataFrame(list(enumerate(result.render(fmt))), "n int, line string")

    return run


def _stream(query: str) -> Callable[[SparkSession, str], DataFrame]:
    """A row-wise plan over a stream of files, through a file sink."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        Engine(spark)
        at, out = _written(spark, _events(spark, sf_dir), F.when(F.col("event_id") % 10 == 3, "{broken").otherwise(_LINES["ndjson"]()), "log"), _folder(spark)
        stream = runner.transform(lang.parse(query), runner.lines(spark, at))
        rows = stream.select(F.to_json("fields").alias("value"))
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-at").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema("value string").parquet(out)

    return run


def _command(argv: list[str], text: Callable[[list[dict]], str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """What the command line prints on standard output, a row a line, with the nations on standard input or in a file."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from . import cli

        rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]
        held, cli.session = cli.session, lambda: spark
        out = io.StringIO()
        try:
            cli.main(argv, io.StringIO((text or _as_lines)(rows)), out, io.StringIO())
        finally:
            cli.session = held
        return spark.createDataFrame(list(enumerate(out.getvalue().splitlines())), "n int, line string")

    return run


def _as_lines(rows: list[dict]) -> str:
    return "".join(json.dumps(r) + "\n" for r in rows)


def _as_csv(rows: list[dict]) -> str:
    return "\n".join([",".join(rows[0]), *(",".join(map(str, r.values())) for r in rows)])


def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """now+-duration against a fixed now, the last event less a day."""
    frame = readers.parquet(spark, f"{sf_dir}/events.parquet")
    now = frame.df.agg(F.unix_seconds(F.max("ts").cast("timestamp"))).first()[0]
    return Engine(spark).query(frame, "where ts gte now-36h, ts lt now-12h count", now=now).df


def _tags(query: str) -> Callable[[SparkSession, str], DataFrame]:
    """The parts with their names as arrays of words."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.split("p_name", " ").alias("words"))
        return Engine(spark).query(words, query).df.select("p_partkey")

    return run


_KINDS = "CASE WHEN event_id % 4 = 0 THEN 'null' WHEN event_id % 4 = 1 THEN 'string' WHEN event_id % 4 = 2 THEN 'number' ELSE 'missing' END"


def _mixed() -> Column:
    """Lines whose field x is null, a text, a number or not there."""
    rest = F.concat(F.lit('"event_id":'), _cell("event_id"), F.lit("}"))
    i = F.col("event_id") % 4
    return F.concat(F.lit("{"), F.when(i == 0, '"x":null,').when(i == 1, F.concat(F.lit('"x":" '), _cell("user_id"), F.lit('5",'))).when(i == 2, F.concat(F.lit('"x":'), _cell("user_id"), F.lit(","))).otherwise(""), rest)


_EV = "(SELECT event_id, user_id, event_type, round(value, 4) AS value, ts FROM events)"
_BY_USER = "SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS count FROM events WHERE event_type='error' GROUP BY 1"
_ROUND_SUM = f"SELECT round(sum(value),6) AS sum FROM {_EV} WHERE event_type='error'"
_QUERY, _SUM = "where event_type=error count by user_id", "where event_type=error sum value"
_SHOWN = "(SELECT event_id, event_type, user_id FROM events ORDER BY event_id LIMIT 20)"

#: name: (query, SQL)
FORMATS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "src_ndjson": (_read("ndjson", _QUERY), _BY_USER),
    "src_ndjson_sniffed": (_read("log", _QUERY, line="ndjson"), _BY_USER),
    "src_json_sniffed": (_json_document, _ROUND_SUM),
    "src_csv": (_read("csv", "where event_type glob error?? sum value"), _ROUND_SUM),
    "src_csv_gzip": (_read("csv", "where ts gte 2024-01-15T00:00:00Z sum value", packed=True), f"SELECT round(sum(value),6) AS sum FROM {_EV} WHERE ts >= TIMESTAMP '2024-01-15'"),
    "src_tsv": (_read("tsv", _QUERY), _BY_USER),
    "src_headerless": (_read("csv", "sum col4", header=False), f"SELECT round(sum(value),6) AS sum FROM {_EV}"),
    "src_separator": (_read("dat", "where col3=error count by col2", line="tsv", sep="\t", header=False), _BY_USER.replace("user_id", "col2", 1).replace("AS VARCHAR) AS user_id", "AS VARCHAR) AS col2").replace("CAST(col2", "CAST(user_id")),
    "src_logfmt": (_read("logfmt", _SUM, sniffed=False), _ROUND_SUM),
    "src_logfmt_sniffed": (_read("log", _QUERY, line="logfmt"), _BY_USER),
    "src_yaml": (_read("yaml", _SUM, written=lambda df: df.where("event_id < 400")), f"SELECT round(sum(value),6) AS sum FROM {_EV} WHERE event_type='error' AND event_id < 400"),
    "src_toml": (_toml_document, "SELECT 'names.k' || n_nationkey AS field, n_name AS name FROM nation WHERE n_nationkey IN (0, 7)"),
    "src_text": (_read("txt", "where line contains ERROR count", line="text"), "SELECT count(*) AS count FROM events WHERE event_type='error'"),
    "src_gzip": (_read("log", _QUERY, line="ndjson", packed=True), _BY_USER),
    "src_many_files": (_many_files, "SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS count FROM events GROUP BY 1"),
    "dyn_dup_keys": (_line_query(lambda: F.format_string('{"user_id":-1,"n":{"v":0,"v":%s},"user_id":%s}', _cell("event_id"), _cell("user_id")), "where n.v gte 10 count by user_id"), "SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS count FROM events WHERE event_id >= 10 GROUP BY 1"),
    "dyn_line_separator": (_line_query(lambda: F.concat(F.lit('{"a":"x\u2028y\u0085z","user_id":'), _cell("user_id"), F.lit("}\r")), "count by user_id"), "SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS count FROM events GROUP BY 1"),
    "dyn_types_mixed": (_line_query(_mixed, "count types x"), f"SELECT {_KINDS} AS type, count(*) AS count FROM events GROUP BY 1"),
    "dyn_exists": (_line_query(_mixed, "where x exists count"), "SELECT count(*) AS count FROM events WHERE event_id % 4 <> 3"),
    "dyn_not_exists": (_line_query(_mixed, "not .x exists | count()"), "SELECT count(*) AS count FROM events WHERE event_id % 4 = 3"),
    "dyn_sum_mixed": (_line_query(_mixed, "sum x"), "SELECT CAST(sum(CASE event_id % 4 WHEN 2 THEN user_id END) AS DOUBLE) AS sum FROM events"),
    "dyn_cast_number": (lambda s, d: Engine(s).query(_written(s, _events(s, d), _mixed(), "log"), "sum x", casts={"x": "number"}, fmt="ndjson").df, "SELECT CAST(sum(CASE event_id % 4 WHEN 2 THEN user_id END) AS DOUBLE) AS sum FROM events"),
    "dyn_cast_auto": (lambda s, d: Engine(s).query(_written(s, _events(s, d), F.format_string('{"x":"%s"}', F.when(F.col("event_id") % 3 == 0, "true").when(F.col("event_id") % 3 == 1, _cell("value")).otherwise("N/A")), "log"), "count types x", casts={"x": "auto"}, fmt="ndjson").df, "SELECT CASE event_id % 3 WHEN 0 THEN 'bool' WHEN 1 THEN 'number' ELSE 'null' END AS type, count(*) AS count FROM events GROUP BY 1"),
    "dyn_map_div0": (_line_query(lambda: F.format_string('{"user_id":%s,"z":%s}', _cell("user_id"), (F.col("event_id") % 2).cast("string")), "| map(.r = .user_id / .z) | sum(.r)"), "SELECT CAST(sum(user_id) FILTER (WHERE event_id % 2 = 1) AS DOUBLE) AS sum FROM events"),
    "dyn_omit_path": (_line_query(_LINES["ndjson"], "| omit(.ts.x, .value) | group_by(.value)"), "SELECT '' AS value, count(*) AS count FROM events"),
    "kw_now_window": (_window, "SELECT count(*) AS count FROM events WHERE epoch(ts)::BIGINT >= (SELECT floor(epoch(max(ts)))::BIGINT FROM events) - 129600 AND floor(epoch(ts))::BIGINT < (SELECT floor(epoch(max(ts)))::BIGINT FROM events) - 43200"),
    "dsl_group_by_count": (lambda s, d: Engine(s).query(s.read.parquet(f"{d}/nation.parquet").select(F.col("n_regionkey").alias("count")), "| group_by(.count)").df, "SELECT count(*) AS count FROM nation GROUP BY n_regionkey"),
    "dsl_contains_element": (_tags('.words contains "WIDGET"'), "SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'widget')"),
    "dsl_length_array": (_tags(".p_partkey > 10 | map(.n = length(.words)) | pick(.p_partkey, .n)"), "SELECT p_partkey FROM part WHERE p_partkey > 10"),
    "dsl_map_div0_kept": (lambda s, d: Engine(s).query(readers.parquet(s, f"{d}/events.parquet"), "| map(.r = .value / (.user_id - .user_id)) | pick(.event_id, .r)").df, "SELECT event_id, CAST(NULL AS DOUBLE) AS r FROM events"),
    "cast_number_text": (lambda s, d: Engine(s).query(s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "n/a").when(F.col("c_custkey") % 5 == 1, "x1").otherwise(F.concat(F.lit("+"), F.col("c_nationkey").cast("string"), F.lit("e1"))).alias("t")), "sum t", casts={"t": "number"}).df, "SELECT CAST(sum(c_nationkey * 10) AS DOUBLE) AS sum FROM customer WHERE c_custkey % 5 > 1"),
    "snk_ndjson": (_rendered("ndjson"), f"""SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS INTEGER) AS n, '{{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}}' AS line FROM {_SHOWN}"""),
    "snk_csv": (_rendered("csv"), f"SELECT 0 AS n, 'event_id,event_type,user_id' AS line UNION ALL SELECT CAST(row_number() OVER (ORDER BY event_id) AS INTEGER), event_id || ',' || event_type || ',' || user_id FROM {_SHOWN}"),
    "snk_pretty": (_rendered("pretty"), f"""SELECT CAST(2 * row_number() OVER (ORDER BY event_id) - 1 AS INTEGER) AS n, '' AS line FROM {_SHOWN} QUALIFY n < 39 UNION ALL SELECT CAST(2 * row_number() OVER (ORDER BY event_id) - 2 AS INTEGER) AS n, '{{' || chr(10) || '  "event_id": ' || event_id || ',' || chr(10) || '  "event_type": "' || event_type || '",' || chr(10) || '  "user_id": ' || user_id || chr(10) || '}}' AS line FROM {_SHOWN}"""),
    "snk_raw": (_command(["where", "n_regionkey=1", "--fmt", "raw"], lambda rows: "".join(f'  {json.dumps(r)}\n' for r in rows)), """SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS n, '{"n_nationkey": ' || n_nationkey || ', "n_name": "' || n_name || '", "n_regionkey": ' || n_regionkey || '}' AS line FROM nation WHERE n_regionkey = 1"""),
    "cli_stdin_stream": (_command(["where", "n_nationkey", "gte", "5", "select", "n_name", "limit", "7"]), """SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS n, '{"n_name":"' || n_name || '"}' AS line FROM nation WHERE n_nationkey >= 5 QUALIFY n < 7"""),
    "cli_stdin_batch": (_command(["count", "by", "n_regionkey", "--fmt", "csv"], _as_csv), "SELECT 0 AS n, 'n_regionkey,count' AS line UNION ALL SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, min(n_nationkey)) AS INTEGER), n_regionkey || ',' || count(*) FROM nation GROUP BY n_regionkey"),
    "cli_expression": (_command([".n_regionkey == 2 | pick(.n_nationkey)", "-q"]), """SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS n, '{"n_nationkey":' || n_nationkey || '}' AS line FROM nation WHERE n_regionkey = 2"""),
    "stream_filter": (_stream("where event_type=error select event_id"), """SELECT '{"event_id":' || event_id || '}' AS value FROM events WHERE event_type = 'error' AND event_id % 10 <> 3"""),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name, e in ENTRIES.items():
        out[name] = lambda s, d, e=e: Engine(s).query(readers.parquet(s, f"{d}/{e.table}.parquet"), e.text, e.case_sensitive, e.casts).df
    for name, (text, _) in RECORDS.items():
        if name == "dyn_cast_bool":
            out[name] = lambda s, d: Engine(s).query(_records(s, d), "count by user_id", casts={"user_id": "bool"}).df
        else:
            out[name] = lambda s, d, text=text: Engine(s).query(_records(s, d), text).df
    return out | {name: run for name, (run, _) in FORMATS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: e.sql for n, e in ENTRIES.items()} | {n: sql for n, (_, sql) in RECORDS.items()} | {n: sql for n, (_, sql) in FORMATS.items()}


__all__ = ["CountByTime", "ENTRIES", "FORMATS", "RECORDS", "oracle_sql", "queries"]
