import corpus_pipeline
import pytest
from grovemap.llm import registry


@pytest.fixture(scope="module")
def folder(tmp_path_factory, messy, labels, spark):
    d = tmp_path_factory.mktemp("sf")
    messy.drop("id").write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "old river bank today and more words that nobody else has")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_on_messy_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert len(set(out.columns)) == len(out.columns)
        assert set(columns) <= set(out.columns) if k == 4 else out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() > 0


def test_run_equals_its_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(map(tuple, corpus_pipeline.run(spark, d).collect()), key=str)


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_each_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
