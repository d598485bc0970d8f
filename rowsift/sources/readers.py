"""Readers: paths to frames.

Line formats, tables of cells and JSON documents are read as splits, so large files are parsed in parallel; YAML and TOML documents,
packed JSON, and tables with line feeds inside of cells, are read one file a task.  Parquet and DataFrames keep their types.
"""

from __future__ import annotations

import csv as _csv
import gzip
import io
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import batched, chain
from pathlib import Path
from typing import BinaryIO, TextIO
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FormatError
from ..operators.frame import Frame
from ..operators.lower import auto_coerce
from . import documents
from .detect import HEAD, sniff
from .parse import WHOLE, json_text, logfmt

DYNAMIC = "map<string,variant>"
DOC = "__doc"


def from_dataframe(df: DataFrame) -> Frame:
    """A typed frame; a DataFrame that is a map ``fields`` of variants is a dynamic one."""
    kinds = dict(df.dtypes)
    return Frame(df, dynamic=kinds.get("fields") == DYNAMIC)


#: Files whose places in the order of the input are told by a literal map.
NUMBERED_FILES = 256


def parquet(spark: SparkSession, *paths: str) -> Frame:
    """Typed frame in file order: by path, then by row; row numbers are read only if the order matters.

    A position is one number, place of the file << 40 | row, so that it aggregates in hash tables; with very many files it is the pair.
    """
    df = spark.read.parquet(*paths)
    files = sorted(df.inputFiles())
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    if len(files) == 1:
        return Frame(df, position=row)
    if len(files) > NUMBERED_FILES:
        return Frame(df, position=F.struct(path, row))
    return Frame(df, position=F.shiftleft(_place(files), 40).bitwiseOR(row))


def _place(files: list[str]) -> Column:
    """Which of these files a row is of; a local path is written with one slash or three."""
    path, local = F.col("_metadata.file_path"), files[0].startswith("file:")
    if local:
        path, files = F.replace(path, F.lit("file:///"), F.lit("file:/")), [f.replace("file:///", "file:/") for f in files]
    return F.try_element_at(F.create_map(*(x for i, f in enumerate(files) for x in (F.lit(f), F.lit(i).cast("long")))), path)


def records(fields: Column, raw: Column) -> list[Column]:
    return [fields.alias("fields"), raw.alias("_raw")]


def _once(df: DataFrame) -> DataFrame:
    """The rows, with the random column that keeps filters above from being moved below, where they would work the fields out again and again."""
    return df.withColumn("__once", F.rand(0)).where(F.col("__once") >= 0)


def ndjson_columns(line: Column, doc: Column | None = None) -> tuple[Column, Column]:
    """(fields, corrupt) of a line, and of the line parsed if that is at hand; a value that is no object becomes ``{"value": v}``."""
    value = F.try_parse_json(line) if doc is None else doc
    fields = F.from_json(line, DYNAMIC)
    fields = F.when(F.schema_of_variant(value).startswith("OBJECT"), fields).otherwise(F.create_map(F.lit("value"), value))
    return fields, value.isNull()


def _lines(spark: SparkSession, path: str, file_index: int) -> DataFrame:
    """(value, _ord, _src_file) of a text file, cut at line feeds alone; blank lines are still there."""
    lines = spark.read.option("lineSep", "\n").text(path)
    order = F.struct(F.lit(file_index).alias("file"), _block(lines).alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select(_bare(F.validate_utf8("value")).alias("value"), order.alias("_ord"), F.lit(path).alias("_src_file"))


def _block(files: DataFrame) -> Column:
    """Where a row's block stands: in its file, and that among the files by path; with very many files, in its file alone."""
    paths, start = sorted(files.inputFiles()), F.col("_metadata.file_block_start")
    if not 1 < len(paths) <= NUMBERED_FILES:
        return start
    return F.shiftleft(_place(paths), 40).bitwiseOR(start)


def _bare(line: Column) -> Column:
    """A line without the carriage return at its end."""
    return F.when(line.endswith("\r"), line.substr(F.lit(1), F.length(line) - 1)).otherwise(line)


def split_lines(text: str) -> list[str]:
    """Lines of a text, cut at line feeds alone."""
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    return lines[:-1] if lines[-1] == "" else lines


BLANKS = " \t\r\n\f\x0b"


def _head(spark: SparkSession, path: str, n: int = HEAD) -> bytes:
    """First bytes of a file, or of the first file of a folder, wherever Hadoop's file systems find it."""
    if "://" not in path:
        p = Path(path.removeprefix("file:"))
        if p.is_dir():
            p = next(iter(sorted(x for x in p.iterdir() if x.is_file() and x.name[0] not in "._")), p)
        with p.open("rb") as f:
            return f.read(n)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        inside = sorted((f.getPath().toString(), f.getPath()) for f in fs.listStatus(at) if f.isFile() and f.getPath().getName()[0] not in "._")
        at = inside[0][1] if inside else at
    stream = fs.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def _unpacked(head: bytes) -> bytes:
    """What the first bytes of a gzip file unpack to."""
    return zlib.decompressobj(31).decompress(head) if head[:2] == b"\x1f\x8b" else head


def _opened(data: bytes, newline: str) -> TextIO:
    """A text that is unpacked and decoded as it is read."""
    packed: BinaryIO = io.BytesIO(data)
    return io.TextIOWrapper(gzip.GzipFile(fileobj=packed) if data[:2] == b"\x1f\x8b" else packed, encoding="utf-8", newline=newline)


def read(spark: SparkSession, path: str, fmt: str | None = None, header: bool = True, sep: str | None = None, file_index: int = 0) -> Frame:
    """One file or folder as a frame; the format is sniffed unless it is given, and ``sep`` forces CSV."""
    if sep is not None and (len(sep) != 1 or not sep.isascii()):
        raise FormatError(f"the separator must be one ASCII character, got {sep!r}")
    head = _head(spark, path) if fmt is None or fmt == "gzip" else b""
    fmt = fmt or sniff(head, path)
    packed = fmt == "gzip"
    if packed:
        fmt = sniff(_unpacked(_head(spark, path, 1 << 16))[:HEAD], path[:-3] if path.endswith(".gz") else None)
    if sep is not None:
        fmt = "csv"
    if fmt == "parquet":
        return parquet(spark, path)
    named = not packed or all(f.endswith(".gz") for f in spark.read.text(path).inputFiles())  # Spark unpacks by the ending only
    if fmt in ("csv", "tsv") and named and (cells := _split_cells(spark, path, header, sep or ("\t" if fmt == "tsv" else ","), file_index)):
        return cells
    if fmt == "json" and not packed and (split := _split_documents(spark, path, file_index)):
        return split
    if fmt in WHOLE or fmt in ("csv", "tsv") or not named:
        return _whole(spark, path, fmt, header, sep or ("\t" if fmt == "tsv" else ","), file_index)
    lines = _lines(spark, path, file_index)
    if fmt == "text":
        rows = lines.where("value != ''")
        out = rows.select(F.create_map(F.lit("line"), F.col("value").cast("variant")).alias("fields"), F.col("value").alias("_raw"), "_ord", "_src_file")
        return Frame(out, dynamic=True, order=(F.col("_ord").asc(),))
    rows = lines.withColumn("value", F.btrim("value", F.lit(BLANKS))).where("value != ''")
    return _parsed(rows, fmt)


def _parsed(rows: DataFrame, fmt: str) -> Frame:
    if fmt == "logfmt":
        return Frame(_once(rows.select(_logfmt(F.col("value")).alias("fields"), F.col("value").alias("_raw"), "_ord", "_src_file")), dynamic=True, order=(F.col("_ord").asc(),))
    # each line is parsed once, below whatever a query asks of it: the random column keeps filters from being moved below the parsing
    marked = rows.select("*", F.try_parse_json("value").alias(DOC), F.rand(0).alias("__once"))
    good, bad = marked.where(F.col(DOC).isNotNull() & (F.col("__once") >= 0)), marked.where(F.col(DOC).isNull())
    fields, _ = ndjson_columns(F.col("value"), F.col(DOC))
    good = good.select(fields.alias("fields"), F.col("value").alias("_raw"), "_ord", "_src_file", DOC)
    return Frame(good, dynamic=True, order=(F.col("_ord").asc(),), warnings=((bad.select("value", "_src_file"), "corrupt line skipped"),), doc=DOC)


#: A line all of whose words are key=value without quotes.
_REGULAR = r"^\s*+(?:[^\s=]++=(?:[^\s\"]\S*+)?+(?:\s++|$))++$"


def _logfmt(line: Column) -> Column:
    """Fields of a line; lines with quotes, keys of several words or repeated keys are left to the parser."""
    words = F.split(F.btrim(line, F.lit(BLANKS)), r"\s+")
    keys = F.transform(words, lambda w: F.substring_index(w, "=", 1))
    regular = line.rlike(_REGULAR) & (F.size(F.array_distinct(keys)) == F.size(keys))
    values = F.transform(words, lambda w: w.substr(F.length(F.substring_index(w, "=", 1)) + 2, F.length(w)).cast("variant"))

    def parse(lines: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(lines), index=lines.index, dtype=object)
        rest = lines.notna()
        out[rest] = lines[rest].map(lambda x: json_text(logfmt(x)))
        return out

    parsed = F.from_json(F.pandas_udf(parse, "string")(F.when(~regular, line)), DYNAMIC)
    return F.when(regular, F.map_from_arrays(keys, values)).otherwise(parsed)


#: Rows that a task which parses a file as a whole returns at once.
RETURNED = 10_000


def _whole(spark: SparkSession, path: str, fmt: str, header: bool, sep: str, file_index: int) -> Frame:
    """Files parsed as a whole: documents, tables of cells, and whatever is packed without saying so."""
    if fmt in ("csv", "tsv"):
        return _cells(spark, path, header, sep, file_index)
    files = spark.read.format("binaryFile").load(path)
    files = files.select("path", "content", _block(files).alias("block"))

    def texts(content: bytes) -> Iterator[tuple[str, str]]:
        """(JSON, original text) of each record."""
        text = _opened(content, "\n")
        if fmt in WHOLE:
            yield from ((t, t) for t in map(json_text, WHOLE[fmt](text.read())))
            return
        for x in (line.removesuffix("\n").removesuffix("\r") for line in text):
            if fmt == "text":
                if x:
                    yield json_text({"line": x}), x
            elif fmt == "logfmt":
                if x.strip():
                    yield json_text(logfmt(x)), x.strip()
            elif x.strip(BLANKS):
                yield x.strip(BLANKS), x.strip(BLANKS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content, block in batch.itertuples(index=False):
                try:
                    for rows in batched(enumerate(texts(content)), RETURNED):
                        yield pd.DataFrame([(j, r, block, i, name) for i, (j, r) in rows], columns=["json", "_raw", "block", "row", "_src_file"])
                except UnicodeDecodeError as e:
                    raise FormatError(f"{name}: not valid UTF-8") from e

    rows = files.mapInPandas(run, "json string, _raw string, block long, row long, _src_file string")
    order = F.struct(F.lit(file_index).alias("file"), "block", "row")
    rows = rows.withColumn("_ord", order)
    if fmt == "ndjson":
        return _parsed(rows.select(F.col("json").alias("value"), "_ord", "_src_file"), fmt)
    return Frame(_once(rows.select(F.from_json("json", DYNAMIC).alias("fields"), "_raw", "_ord", "_src_file")), dynamic=True, order=(F.col("_ord").asc(),))


#: Endings of files that Spark unpacks.
PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".zstd", ".xz", ".lzo")


def _split_documents(spark: SparkSession, path: str, file_index: int) -> Frame | None:
    """JSON documents read in splits, unless they are packed."""
    key, whole = F.xxhash64("_metadata.file_path"), spark.read.format("binaryFile").load(path)
    files = whole.select(key.alias("key"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).sort("path").collect()
    names = {f.key: f.path for f in files}
    if len(names) < len(files) or any(f.path.lower().endswith(PACKED) for f in files):
        return None
    chunks = spark.read.option("lineSep", "}").text(path).select(key.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    begin = documents.starts(chunks.mapInArrow(documents.summaries, documents.SUMMARY).collect(), {f.key: f.size for f in files}, names)
    places = {f.key: i for i, f in enumerate(files)}
    rows = chunks.mapInArrow(documents.cutter(begin, names, places, True), documents.CUT).select("file", "block", "row", "json")
    if any(s.owner is not None for s in begin.values()):
        parts = chunks.mapInArrow(documents.cutter(begin, names, places, False), documents.CUT).select("file", "block", "owner", "part")
        rows = rows.unionByName(parts.groupBy("file", "owner").applyInPandas(documents.mended([f.path for f in files]), "file long, block long, row long, json string"))
    order = F.struct(F.lit(file_index).alias("file"), F.shiftleft("file", 40).bitwiseOR(F.col("block")).alias("block"), "row")
    return Frame(_once(rows.select(F.from_json("json", DYNAMIC).alias("fields"), F.col("json").alias("_raw"), order.alias("_ord"), F.lit(path).alias("_src_file"))), dynamic=True, order=(F.col("_ord").asc(),))


def _split_cells(spark: SparkSession, path: str, header: bool, sep: str, file_index: int) -> Frame | None:
    """CSV read in splits, if no cell holds a line feed and all files have the same columns; else None."""
    lines = spark.read.text(path)
    firsts = []
    for file in map(unquote, lines.inputFiles()):
        at = file.removeprefix("file://") if file.startswith("file:///") else file
        if head := _unpacked(_head(spark, at, 1 << 16)):
            firsts.append(next((x for x in head.split(b"\n")[:-1] if x.strip()), None))
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    flags = lines.agg(F.bool_or(odd), F.bool_or(~F.is_valid_utf8("value"))).first()
    if flags[1]:
        raise FormatError(f"{path}: not valid UTF-8")
    if not firsts or None in firsts or flags[0]:
        return None
    heads = [next(_csv.reader([x.decode("utf-8").removeprefix("\ufeff").removesuffix("\r")], delimiter=sep, strict=True)) for x in firsts]
    names, *others = ([c.strip() for c in cells] if header else [f"col{i + 1}" for i in range(len(cells))] for cells in heads)
    if any(x != names for x in others):
        return None
    schema = ", ".join(f"c{i} string" for i in range(len(names))) + ", __bad string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", "sep": sep, "header": header, "quote": '"', "escape": '"', "columnPruning": False, "maxColumns": max(20480, 2 * len(names))}
    rows = spark.read.schema(schema).options(**options).csv(path)
    wrong = F.raise_error(F.concat(F.lit(f"{path}: a row has too many or too few cells, expected {len(names)}: "), F.col("__bad"))).cast("boolean")
    rows = rows.select("*", F.struct(F.lit(file_index).alias("file"), _block(rows).alias("block"), F.monotonically_increasing_id().alias("row")).alias("_ord"))
    rows = rows.where(F.when(F.col("__bad").isNotNull(), wrong).otherwise(F.coalesce("c0", F.lit("")) >= ""))  # a query may not ask for the broken rows alone
    text = [F.coalesce(f"c{i}", F.lit("")) for i in range(len(names))]
    last = {name: i for i, name in enumerate(names)}  # of columns with one name the last counts, at the place of the first
    fields = F.map_from_arrays(F.array(*(F.lit(n) for n in last)), F.array(*(auto_coerce(text[i], trimmed=True) for i in last.values())))
    return Frame(_once(rows.select(fields.alias("fields"), F.concat_ws(",", *(text[i] for i in last.values())).alias("_raw"), "_ord", F.lit(path).alias("_src_file"))), dynamic=True, order=(F.col("_ord").asc(),))


def _cells(spark: SparkSession, path: str, header: bool, sep: str, file_index: int) -> Frame:
    """CSV: cells are texts turned into null, bool, integer, number or trimmed text one by one; ragged rows are an error."""
    files = spark.read.format("binaryFile").load(path)
    files = files.select("path", "content", _block(files).alias("block"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content, block in batch.itertuples(index=False):
                try:
                    for rows in batched(csv_rows(_opened(content, ""), header, sep, name), RETURNED):
                        yield pd.DataFrame(rows, columns=["names", "cells", "row"]).assign(block=block)
                except UnicodeDecodeError as e:
                    raise FormatError(f"{name}: not valid UTF-8") from e

    rows = files.mapInPandas(run, "names array<string>, cells array<string>, row long, block long")
    fields = F.map_from_arrays("names", F.transform("cells", lambda c: auto_coerce(c, trimmed=True)))
    order = F.struct(F.lit(file_index).alias("file"), "block", "row")
    return Frame(_once(rows.select(fields.alias("fields"), F.array_join("cells", ",").alias("_raw"), order.alias("_ord"), F.lit(path).alias("_src_file"))), dynamic=True, order=(F.col("_ord").asc(),))


def csv_rows(text: TextIO, header: bool, sep: str, name: str = "") -> Iterator[tuple[list[str], list[str], int]]:
    lines = (r for r in _csv.reader(text, delimiter=sep, strict=True) if r)
    first = next(lines, None)
    if first is None:
        return
    names = [c.strip() for c in first] if header else [f"col{i + 1}" for i in range(len(first))]
    shown = list(dict.fromkeys(names))
    for i, cells in enumerate(lines if header else chain([first], lines)):
        if len(cells) != len(names):
            raise FormatError(f"{name}: row {i + 1 + header} has {len(cells)} cells, expected {len(names)}")
        of = dict(zip(names, cells, strict=True))
        yield shown, [of[n] for n in shown], i


def text_frame(spark: SparkSession, text: str, fmt: str | None = None, header: bool = True, sep: str | None = None) -> Frame:
    """A frame of a text at hand, such as standard input."""
    fmt = "csv" if sep else fmt or sniff(text.encode()[:HEAD])
    if fmt in ("csv", "tsv"):
        rows = list(csv_rows(io.StringIO(text, newline=""), header, sep or ("\t" if fmt == "tsv" else ",")))
        df = spark.createDataFrame(rows, "names array<string>, cells array<string>, row long")
        fields = F.map_from_arrays("names", F.transform("cells", lambda c: auto_coerce(c, trimmed=True)))
        df = df.select(fields.alias("fields"), F.array_join("cells", ",").alias("_raw"), F.col("row").alias("_ord"), F.lit("").alias("_src_file"))
        return Frame(_once(df), dynamic=True, order=(F.col("_ord").asc(),))
    if fmt in WHOLE:
        lines = [json_text(r) for r in WHOLE[fmt](text)]
        fmt = "ndjson"
    else:
        lines = [x if fmt == "text" else x.strip(BLANKS) for x in split_lines(text)]
    rows = spark.createDataFrame([(x, i, "") for i, x in enumerate(lines) if x], "value string, _ord long, _src_file string")
    if fmt == "text":
        return Frame(rows.select(F.create_map(F.lit("line"), F.col("value").cast("variant")).alias("fields"), F.col("value").alias("_raw"), "_ord", "_src_file"), dynamic=True, order=(F.col("_ord").asc(),))
    return _parsed(rows, fmt)


def to_dynamic(f: Frame) -> Frame:
    """A typed frame as records; nulls of columns whose nulls mean absence are left out."""
    if f.dynamic:
        return f
    entries = []
    for name in f.names:
        value = F.try_parse_json(f.value(name).json)
        entries.append(F.struct(F.lit(name).alias("key"), (F.when(F.col(f"`{name}`").isNotNull(), value) if name in f.missing else value).alias("value")))
    fields = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
    hidden = [c for c in ("_ord", "_raw", "_src_file") if c in f.df.columns]
    return Frame(f.df.select(fields.alias("fields"), *hidden), dynamic=True, order=f.order, warnings=f.warnings)


def concat(frames: list[Frame]) -> Frame:
    """Frames in the order given; schemas may differ."""
    if len(frames) == 1:
        return frames[0]
    if all(not f.dynamic for f in frames):
        numbered = [f.ordered() for f in frames]
        dfs = [f.df.withColumn("_ord", F.struct(F.lit(i).alias("file"), F.to_json(F.struct("_ord")).alias("at"), F.monotonically_increasing_id().alias("row"))) for i, f in enumerate(numbered)]
        names = [set(f.names) for f in frames]
        missing = frozenset().union(*(f.missing for f in frames), *(set().union(*names) - n for n in names))
        return Frame(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs), missing=missing, order=(F.col("_ord.file"), F.col("_ord.row")))
    dfs, whole = [], all(f.doc for f in frames)
    for i, f in enumerate(frames):
        d = to_dynamic(f.ordered())
        row = F.struct(F.lit(i).alias("file"), F.monotonically_increasing_id().alias("row"))
        if "_ord" in d.df.columns and dict(d.df.dtypes)["_ord"].startswith("struct<file:int,block"):
            row = F.struct(F.lit(i).alias("file"), F.col("_ord.block").alias("block"), F.col("_ord.row").alias("row"))
        else:
            row = F.struct(F.lit(i).alias("file"), F.lit(0).cast("long").alias("block"), F.monotonically_increasing_id().alias("row"))
        extra = [c if c in d.df.columns else F.lit(None).cast("string").alias(c) for c in ("_raw", "_src_file")] + ([DOC] if whole else [])
        dfs.append(d.df.select("fields", *extra, row.alias("_ord")))
    return Frame(reduce(DataFrame.unionByName, dfs), dynamic=True, order=(F.col("_ord").asc(),), warnings=tuple(w for f in frames for w in f.warnings), doc=DOC if whole else None)
