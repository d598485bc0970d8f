import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from rowsift.llm import queries
from rowsift.llm.common import row_key
from rowsift.llm.decontaminate import clean, shared_spans
from rowsift.llm.mixing import copies_of, mixing_rates
from rowsift.llm.quality import verdicts
from rowsift.llm.sharding import plan
from rowsift.llm.simhash import near_duplicates, one_per_group

from .conftest import DOCS, frame, prose

SF = "/root/testdata/sf0.001"


def test_each_stage_does_what_its_operator_says(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality":
            assert ids(out) == ids(verdicts(docs).where("keep"))
        elif name == "near_duplicates":
            assert ids(out) == ids(docs) - ids(near_duplicates(docs)) and near_duplicates(out).count() == 0
        elif name == "decontamination":
            bad = shared_spans(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert ids(out) == ids(docs) - ids(bad)
        elif name == "mixing":
            times = {r.doc_id: r.copies for r in mixing_rates(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
            assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {d: n for d, n in times.items() if n}
            assert max(times.values()) > 1 and min(times.values()) == 0
        else:
            shard = {(r.source, r.block): r["shard"] for r in plan(docs).collect()}
            assert out.count() == docs.count() and all(r.shard == shard[r.source, r.doc_id // 256] for r in out.collect())
        if i < len(pipeline.STAGES) - 1:
            assert out.columns == columns and out.subtract(docs).isEmpty()
        docs = out
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, pipeline.run(spark, SF).collect()))


def test_stages_are_the_five_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_run_without_documents(spark, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_of_nulls_pass_through(spark, tmp_path):
    spark.createDataFrame([(None, None, None, None, None)] * 3, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() == 3 and out.where(F.col("shard") == 0).count() == 3


def test_rows_without_an_id_are_judged_one_by_one(spark):
    a, item = prose(1, 80), prose(2, 40)
    docs = frame(spark, [(None, a), (None, a), (None, a, "other"), (7, a), (None, prose(3, 30) + " " + item), (None, prose(4, 80)), (None, prose(4, 80), "other"), (None, None), (None, None)])
    kept = one_per_group(docs)
    assert kept.columns == docs.columns and kept.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert [r.doc_id for r in kept.where(F.col("text") == a).collect()] == [7]
    assert kept.where(F.col("text") == prose(4, 80)).count() == 1 and kept.where("text is null").count() == 2 and kept.count() == 5
    left = clean(kept, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.count() == 4 and left.where(F.col("text").contains(item)).isEmpty()
    n = {r.n for r in frame(spark, [(None, prose(i, 5)) for i in range(60)]).select(copies_of(F.lit(0.5), row_key(docs)).alias("n")).collect()}
    assert n == {0, 1}


def test_stages_leave_columns_of_any_name_alone(spark, tmp_path):
    names = ["__id", "__ID_", "__m", "__doubt", "__rank", "__rate", "__n", "__i", "__s", "__b", "__shard", "__bad_host", "__gone", "__kept", "__lab", "shard_", "ord", "upto", "part", "failed", "host"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(frame(spark, [(None, "no id"), (1, "shared id, other text")]))
    docs.select("*", *(F.concat(F.lit(f"{k}-"), F.coalesce("doc_id", F.lit(-1))).alias(name) for k, name in enumerate(names))).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns + (["shard"] if name == "sharding" else [])
        rows = out.select("doc_id", *names).toPandas()
        ids = rows.doc_id.fillna(-1).astype(int).astype(str)
        assert len(rows) > 100 and all((rows[col] == f"{k}-" + ids).all() for k, col in enumerate(names)), name


def test_rows_that_share_an_id_are_decontaminated_one_by_one(spark):
    item = prose(2, 40)
    docs = frame(spark, [(1, prose(3, 40) + " " + item), (1, prose(4, 40)), (None, item), (None, prose(5, 40)), (2, None)])
    left = clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(str(tuple(r)) for r in docs.collect() if item not in (r.text or ""))


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_has_its_query(n):
    assert sum(name.startswith(f"op{n}_") for name in queries.queries()) == 1


def test_sql_belongs_to_queries():
    assert set(queries.oracle_sql()) <= set(queries.queries())
