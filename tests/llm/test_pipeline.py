"""The corpus pipeline: each stage's decisions take effect, and all else is kept."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from starloom.llm.copies import near_copies

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from starloom.llm.common import materialise

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "test")
        out.append(docs)
    return out


def test_stages(spark, stages):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line dedup", "near duplicates", "decontamination", "packing"]
    assert all(s.columns == first.columns for s in stages[:-1])
    n = [first.count(), *(s.count() for s in stages[:-1])]
    assert n[0] > n[1] == n[2] > n[3] >= n[4] > 0.3 * n[0]
    assert near_copies(stages[1].select(F.col("doc_id").alias("id"), "text")).where("id <> component").count() == n[2] - n[3]
    assert near_copies(stages[2].select(F.col("doc_id").alias("id"), "text")).isEmpty()
    texts = stages[0].alias("a").join(stages[1].alias("b"), "doc_id").where("length(b.text) > length(a.text)")
    assert texts.isEmpty()
    packed = stages[-1]
    assert packed.select("doc_id").distinct().count() == n[4]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).where("n <> m OR n > 2048").isEmpty()


def test_stages_take_nulls_repeats_and_other_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20).withColumn("_row", F.lit(1)).withColumn("extra", F.lit("x"))
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a b c", "en", "web", 5), (5, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(odd, allowMissingColumns=True).unionByName(docs.limit(3)).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() > 0, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
