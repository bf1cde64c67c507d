import pytest
from grovemap.llm import common
from grovemap.llm import op8_simhash as op8
from pyspark.sql import functions as F


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_the_way_to_leave_rows_out_does_not_change_them(spark, monkeypatch, most):
    monkeypatch.setattr(common, "SENT_IDS", most)
    docs = spark.range(60).select(F.when(F.col("id") < 50, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"), F.lit(1).alias("_gm_other"))
    ids = common.cut(spark.createDataFrame([(3,), (3,), (49,), (77,)], "_gm_id long"), "ids")
    assert sorted(r[0] for r in common.without(docs, ids).filter("doc_id IS NOT NULL").collect()) == [i for i in range(50) if i not in (3, 49)]
    assert common.without(docs, ids).filter("doc_id IS NULL").count() == 10
    plan = common.without(docs, ids)._jdf.queryExecution().optimizedPlan().toString()
    assert ("broadcast" in plan) == (most > 0)
    twice = docs.unionByName(docs.filter("doc_id < 3"))
    assert sorted(map(str, op8.keep_one(twice).select("doc_id").collect())) == sorted(map(str, op8.keep_one(docs).select("doc_id").collect()))
