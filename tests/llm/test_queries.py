"""Every query of the subpackage equals its SQL where it has one; the pipeline's stages do what they say."""

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

import corpus_pipeline
from likeness.llm import decontaminate, mixing, oracles, packing, quality, queries, simhash


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    assert differences(queries.queries()[name](spark, data), connect(data), oracles.oracle_sql()[name]) == ""


def test_packing_query_covers_every_document(spark, data):
    rows = queries.op10_packing(spark, data)
    ids = {i for r in rows.collect() for i in r["doc_ids"]}
    assert ids == {r["doc_id"] for r in spark.read.parquet(f"{data}/documents.parquet").where("text <> ''").collect()}


def test_stages_do_what_they_say(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    first = docs.limit(1).select((F.col("doc_id") + 50_000).alias("doc_id"), *[c for c in docs.columns if c != "doc_id"])
    now, columns = docs.unionByName(first), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, path = now, str(tmp_path / name.replace(" ", ""))
        stage(spark, before, data).write.parquet(path)
        now = spark.read.parquet(path)
        if name == "packing":
            ids = {i for r in now.collect() for i in r["doc_ids"]}
            assert ids == {r["doc_id"] for r in before.collect()}
            continue
        assert now.columns == columns
        kept, had = ({r["doc_id"] for r in df.collect()} for df in (now, before))
        if name == "quality classifier":
            model = quality.fit(before, spark.read.parquet(f"{data}/labels.parquet"))
            assert kept == {r["doc_id"] for r in quality.score(before, model).collect() if r["quality_score"] >= 0.5}
        elif name == "near-dedup":
            groups = simhash.similar_documents(before).collect()
            assert kept == {r["component_id"] for r in groups} and len(kept) == now.count()
        elif name == "decontamination":
            found = decontaminate.matches(before, spark.read.parquet(f"{data}/benchmark.parquet"))
            assert kept == had - {r["doc_id"] for r in found.collect()}
        else:
            assert kept == {r["doc_id"] for r in mixing.taken_words(before).where("taken > 0").collect()}
    assert packing.ROW >= max(r["n_tokens"] for r in now.collect())
