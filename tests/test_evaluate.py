import csv
import json
import math

import pytest
from pyspark.sql import functions as F

from likeness.operators import splits
from likeness.plans import evaluate, retrievers
from likeness.sources import sinks, synthetic, tables


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("project")
    listings = str(top / "train.csv")
    with open(listings, "w", newline="") as file:
        rows = synthetic.catalogue(spark, 30, 3).collect()
        writer = csv.writer(file)
        writer.writerow(rows[0].asDict())
        writer.writerows(rows)
    own = evaluate.numbered(tables.load_listings(spark, listings))
    split = splits.group_split(own, (0.6, 0.2, 0.2), 0)
    named = split.join(own.select("id", "posting_id"), "id")
    sinks.save_split(named, splits.split_counts(own, split), str(top / "split.csv"), listings, 0, (0.6, 0.2, 0.2))
    vectors = own.select("posting_id", F.array(*[F.hash("label_group", F.lit(i)).cast("float") for i in range(4)]).alias("embedding"))
    vectors.write.parquet(str(top / "vectors"))
    return top, {"name": "t", "rung": 1, "data": {"csv": listings, "split": str(top / "split.csv")}, "retriever": {"type": "bm25"}, "eval": {"latency_sample": 1}}, named


def test_locks_thresholds_and_ledger(spark, project):
    top, config, _ = project
    results = str(top / "results")
    with pytest.raises(PermissionError):
        evaluate.run(spark, config, "test", results)
    with pytest.raises(FileNotFoundError):
        evaluate.run(spark, config, "test", results, unlock_test=True)
    val = evaluate.run(spark, config, "val", results)["metrics"]
    assert 0 < val["f1"] <= 1 and 0 < val["recall@50"] <= 1 and val["n_queries"] == val["pool_size"]
    test = evaluate.run(spark, config, "test", results, unlock_test=True)["metrics"]
    assert test["threshold"] == val["threshold"]
    hard = evaluate.run(spark, {**config, "name": "hard", "eval": {"latency_sample": 0, "distractors": ["train"]}}, "val", results)["metrics"]
    assert hard["n_queries"] == val["n_queries"] and hard["pool_size"] > val["pool_size"] and hard["recall@50"] <= val["recall@50"] and math.isnan(hard["p50_ms"])
    ledger = sorted(tuple(r)[1:5] for r in sinks.ledger_table(spark, f"{results}/ledger.csv").collect())
    assert [r[:3:2] for r in ledger] == [("hard", "val"), ("t", "test"), ("t", "val")]
    record = json.loads((top / "results/runs/t__val.json").read_text())
    assert len(record["threshold_curve"]["thresholds"]) == 101 and record["metrics"]["threshold"] == val["threshold"]
    with pytest.raises(ValueError, match="distract"):
        evaluate.run(spark, {**config, "eval": {"distractors": ["test"]}}, "val", results)
    (top / "old.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="header"):
        sinks.append_ledger(str(top / "old.csv"), record)


def test_nested_retrievers_train_and_rerank(spark, project):
    top, config, _ = project
    dense = {"type": "dense", "path": str(top / "vectors"), "store": {"type": "faiss", "index": "flat", "path": "unused"}, "expand_k": 2}
    fusion = {"type": "fusion", "method": "learned", "model_path": str(top / "fusion.json"), "members": [{"type": "bm25", "canonical_units": True}, dense]}
    full = {**config, "retriever": {"type": "phash_boost", "max_dist": 6, "base": fusion}}
    model = evaluate.train_fusion(spark, full, k=10)
    assert len(model["coef"]) == 4 and json.loads((top / "fusion.json").read_text()) == model
    val = evaluate.split_frame(spark, config, "val")
    found = retrievers.build(full["retriever"])(val, val, 5)
    # Its own hash boosts each query to the top score, which listings of the same words or hash may share.
    assert found.where("query_id = cand_id and score = 1").count() == val.count()
    evaluate.export(spark, full, str(top / "pairs"), n=3, train_queries=20)
    evaluate.mine(spark, full, str(top / "mined"), 5, 2)
    pairs = tables.read_csv(spark, str(top / "pairs/pairs_train"), {"query": "string", "candidate": "string", "base_score": "double", "same": "boolean", "fold": "string"})
    assert pairs.select("query").distinct().count() == 20 and spark.read.csv(str(top / "pairs/upload/pairs_val"), header=True).columns == ["query", "candidate"]
    scores = pairs.select("query", "candidate", F.when(F.col("same"), 2.0).otherwise(-2.0).alias("score"))
    scores.coalesce(1).write.csv(str(top / "scores"), header=True)
    judge = evaluate.train_judge(spark, str(top / "pairs/pairs_train"), str(top / "scores"), str(top / "judge.json"))
    assert judge["features"] == ["base_score", "pair_score"] and judge["coef"][1] > 0
    every = tables.read_csv(spark, str(top / "pairs/pairs_val"), {"query": "string", "candidate": "string", "same": "boolean"})
    every.select("query", "candidate", F.col("same").cast("double").alias("score")).write.csv(str(top / "val_scores"), header=True)
    rerank = {"type": "rerank", "base": full["retriever"], "scores": [str(top / "val_scores")], "judge_path": str(top / "judge.json"), "top_n": 3}
    pool = evaluate.split_frame(spark, config, "train").unionByName(val)
    assert retrievers.build(rerank)(pool, val, 10).where("rank = 1 and query_id = cand_id").count() == val.count()


def test_configuration_errors(spark, tmp_path):
    (tmp_path / "a.toml").write_text('name = "x"\n[data]\ncsv = "c"\n')
    with pytest.raises(ValueError, match="retriever"):
        tables.load_config(str(tmp_path / "a.toml"))
    with pytest.raises(ValueError, match="no retriever"):
        retrievers.build({"type": "nothing"})
    with pytest.raises(ValueError, match="fuses"):
        retrievers.fusion_config({"type": "rerank", "base": {"type": "bm25"}})
    retrievers.register("mine", lambda pool, queries, k, x: x)
    assert retrievers.build({"type": "mine", "x": 3})(None, None, 1) == 3
    (tmp_path / "b.csv").write_text("posting_id,title\n1,a\n")
    with pytest.raises(ValueError, match="lacks"):
        tables.load_listings(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text("posting_id,image,image_phash,title,label_group\n1,a,ff,t,1\n1,a,ff,t,1\n")
    with pytest.raises(ValueError, match="twice"):
        tables.load_listings(spark, str(tmp_path / "c.csv"))


def test_save_split_refuses_silent_change(spark, project, tmp_path):
    _, config, split = project
    out, source, counts = str(tmp_path / "s.csv"), config["data"]["csv"], spark.createDataFrame([("train", 1, 1)], "split string, listings int, groups int")
    for _ in range(2):
        sinks.save_split(split, counts, out, source, 1, (0.7, 0.1, 0.2))
    with pytest.raises(FileExistsError):
        sinks.save_split(split, counts, out, source, 2, (0.7, 0.1, 0.2))
    assert json.loads((tmp_path / "s.json").read_text())["seed"] == 1
    sinks.save_split(split, counts, out, source, 2, (0.7, 0.1, 0.2), force=True)


def test_cached_table_rebuilds_on_change(spark, tmp_path):
    calls, path = [], str(tmp_path / "t")
    build = lambda: calls.append(1) or spark.range(3)
    for source in (spark.range(5), spark.range(5), spark.range(6)):
        assert sinks.cached_table(build, source, path, m=1).count() == 3
    assert len(calls) == 2
    sinks.cached_table(build, spark.range(6), path, m=2)
    assert len(calls) == 3
