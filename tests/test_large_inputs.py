"""Steps whose memory must not grow with the input, over inputs cut small."""

import glob
import gzip
import io
import json
import random
from pathlib import Path

import duckdb
import pytest

from rowsift import catalog
from rowsift.api import Engine
from rowsift.errors import FormatError
from rowsift.sources import readers
from rowsift.sources.parse import json_documents

from .test_oracle import canon

SF = "/root/testdata/sf0.001"


@pytest.fixture
def splits(spark):
    """Splits of 200 bytes, each a task of its own."""
    conf = {"spark.sql.files.maxPartitionBytes": "200b", "spark.sql.files.openCostInBytes": "200b"}
    held = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def _records(n: int) -> list[dict]:
    rnd = random.Random(n)
    texts = ["}", "{[", 'a"}]', "\\", "\\}", "x\ny", "é}", ""]
    return [{"i": i, "s": rnd.choice(texts), "n": {"}": [rnd.choice(texts), {"v": i % 7}], "x": None}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 1])
def test_json_documents_are_read_in_splits(spark, tmp_path, splits, indent):
    rows = _records(45)
    (tmp_path / "in").mkdir()
    for k in range(3):
        own = rows[15 * k : 15 * k + 15]
        text = json.dumps(own[:10], indent=indent, ensure_ascii=False) + "".join(json.dumps(r, indent=indent) for r in own[10:])
        (tmp_path / "in" / f"{k}.json").write_text("[]" + text + "\n" * k)
    frame = readers.read(spark, str(tmp_path / "in"), "json")
    assert frame.df.rdd.getNumPartitions() > 9
    result = Engine(spark).query(frame, "where nosuch!=1")
    assert list(result.records()) == rows
    assert [json.loads(x) for x in result.raw()] == rows


@pytest.mark.parametrize("text", ["[1]", '[{"a":1}', '{"a":1}]', '[{"a":1},]', '[{"a":1} {"a":2}]', '[{"a":1}}', '{"a":', '{"a":"}', '{\\}{}', '5 {"a":1}', '[[{"a":1}]]', '{"a":tru}'])
def test_broken_json_documents_are_errors(spark, tmp_path, splits, text):
    with pytest.raises(FormatError):
        list(json_documents(text))
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="JSON"):
        list(Engine(spark).query(str(tmp_path / "x.json"), "count", fmt="json").records())


def test_the_events_are_written_as_several_json_documents(spark, monkeypatch):
    want = catalog.queries()["src_json_sniffed"](spark, SF).collect()
    monkeypatch.setattr(catalog, "FILE_ROWS", 100)
    at = []
    monkeypatch.setattr(catalog, "_folder", lambda s, f=catalog._folder: at.append(f(s)) or at[-1])
    assert catalog.queries()["src_json_sniffed"](spark, SF).collect() == want
    assert len(glob.glob(f"{at[0].removeprefix('file:')}.json/part-*")) == 10


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_packed_folders_are_read_as_streams_whatever_the_folder_is_called(spark, tmp_path):
    for name, texts in (("a.log", ['{"a":1}\n', '{"a":2}\n']), ("b.csv", ["a,b\n1,x\n", "a,b\n2,y\n"])):
        (tmp_path / name).mkdir()
        for k, text in enumerate(texts):
            (tmp_path / name / f"{k}.txt.gz").write_bytes(gzip.compress(text.encode()))
        result = Engine(spark).query(str(tmp_path / name), "where a gt 0 select a")
        assert list(result.records()) == [{"a": 1}, {"a": 2}]
        assert "binaryFile" not in _plan(result.df)


def test_files_packed_without_saying_so_are_unpacked_bit_by_bit(spark, tmp_path, monkeypatch):
    lines = "".join(f'{{"a":{i}}}\r\n\n' for i in range(25_000))
    (tmp_path / "x.log").write_bytes(gzip.compress(lines.encode()))
    result = Engine(spark).query(str(tmp_path / "x.log"), "where a gte 0")
    assert [r["a"] for r in result.records()] == list(range(25_000))
    whole = io.BytesIO(gzip.compress(random.Random(1).randbytes(1 << 20).hex().encode()))
    monkeypatch.setattr(readers.io, "BytesIO", lambda data: whole)
    readers._opened(whole.getvalue(), "\n").read(10)
    assert whole.tell() < len(whole.getvalue()) / 2


def test_tables_of_several_files_are_read_in_splits_if_their_columns_are_the_same(spark, tmp_path):
    def made(name, texts):
        (tmp_path / name).mkdir()
        for k, text in enumerate(texts):
            (tmp_path / name / f"{k}.csv").write_text(text)
        return str(tmp_path / name)

    engine = Engine(spark)
    same = engine.query(made("same", ["a,b\n2,x\n1,y\n", "", "a , b\n1,z\n"]), "where nosuch!=1")
    assert list(same.records()) == [{"a": 2, "b": "x"}, {"a": 1, "b": "y"}, {"a": 1, "b": "z"}] and "binaryFile" not in _plan(same.df)
    bare = engine.query(made("bare", ["1,2\n", "3,4\n"]), "sum col2", header=False)
    assert list(bare.records()) == [{"sum": 6.0}] and "binaryFile" not in _plan(bare.df)
    other = engine.query(made("other", ["a,b\n1,x\n", "b,a\ny,2\n"]), "where nosuch!=1 select a b")
    assert list(other.records()) == [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    wide = engine.query(made("wide", ["1,2\n", "3,4,5\n"]), "count", header=False)
    assert list(wide.records()) == [{"count": 2}]


def test_rows_of_a_folder_are_in_the_order_of_its_files(spark, tmp_path):
    (tmp_path / "in.log").mkdir()
    for k, n in enumerate((1, 40, 5)):
        (tmp_path / "in.log" / f"{k}.txt").write_text("".join(f'{{"f":{k},"i":{i}}}\n' for i in range(n)))
    got = [(r["f"], r["i"]) for r in Engine(spark).query(str(tmp_path / "in.log"), "where f gte 0").records()]
    assert got == [(k, i) for k, n in enumerate((1, 40, 5)) for i in range(n)]


def test_rows_of_a_folder_of_parquet_files_are_in_the_order_of_its_files(spark, tmp_path):
    for k, n in enumerate((5, 400, 50)):
        spark.range(n).selectExpr(f"{k} AS f", "id AS i").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    paths = [str(tmp_path / "in" / str(k)) for k in range(3)]
    got = [(r["f"], r["i"]) for r in Engine(spark).query(readers.parquet(spark, *paths), "where f gte 0").records()]
    want = [(k, i) for k, n in enumerate((5, 400, 50)) for i in range(n)]
    assert got == want
    assert [(r["f"], r["i"]) for r in Engine(spark).query(readers.parquet(spark, *paths), "| skip(100)").records()] == want[100:]


WRITING = [n for n in catalog.FORMATS if n.startswith(("src_", "stream_", "dyn_"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", WRITING)
def test_queries_that_write_give_the_rows_of_their_sql_over_several_files(spark, duck, monkeypatch, name):
    monkeypatch.setattr(catalog, "FILE_ROWS", 300)
    df = catalog.queries()[name](spark, SF)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(catalog.oracle_sql()[name])
    assert got == canon([d[0] for d in cur.description], cur.fetchall())


def test_files_are_bounded_in_rows(spark, monkeypatch):
    monkeypatch.setattr(catalog, "FILE_ROWS", 100)
    rows = catalog._events(spark, SF)
    n = rows.count()
    for packed, ending in ((False, ".txt"), (True, ".txt.gz")):
        at = catalog._written(spark, rows, catalog._LINES["csv"](), "csv", catalog._HEADS["csv"], packed).removeprefix("file:")
        files = sorted(glob.glob(f"{at}/part-*{ending}"))
        texts = [(gzip.open if packed else open)(f, "rt").read().splitlines() for f in files]
        assert len(files) == -(-n // 100) and all(t[0] == catalog._HEADS["csv"] and len(t) < 200 for t in texts)
        assert [int(x.split(",")[0]) for t in texts for x in t[1:]] == sorted(r.event_id for r in rows.select("event_id").collect())


def test_rows_are_skipped_without_one_task_for_all(spark, tmp_path):
    frame = lambda: readers.parquet(spark, f"{SF}/events.parquet")
    ids = sorted(r.event_id for r in frame().df.select("event_id").collect())
    both = Engine(spark).query(frame(), "| sort_by(.event_id desc) | skip(10) | limit(20)")
    assert [r["event_id"] for r in both.records()] == ids[::-1][10:30]
    assert "TakeOrderedAndProject" in _plan(both.frame.df) and "SinglePartition" not in _plan(both.frame.df)
    rest = Engine(spark).query(frame(), "| sort_by(.event_type) | skip(10)")
    every = list(Engine(spark).query(frame(), "| sort_by(.event_type)").records())
    assert list(rest.records()) == every[10:]
    assert "SinglePartition" not in _plan(rest.frame.df)
    (tmp_path / "x.log").write_text("".join(f'{{"a":{i % 3}}}\n' for i in range(9)))
    lines = Engine(spark).query(str(tmp_path / "x.log"), "| sort_by(.a) | skip(2) | to_upper(.b) | skip(2) | limit(3)")
    assert list(lines.records()) == [{"a": 1}, {"a": 1}, {"a": 2}]
