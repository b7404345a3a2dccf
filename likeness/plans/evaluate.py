"""Runs of a configured pipeline: candidates, threshold, metrics, a record and a ledger row."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.operators import candidates as lists
from likeness.operators import metrics, splits, training
from likeness.plans.retrievers import build, fusion_config
from likeness.sources import sinks, tables


def numbered(listings: DataFrame) -> DataFrame:
    """Listings with a long id, a hash of the posting id, and ``label``."""
    out = listings.withColumns({"id": F.xxhash64("posting_id"), "label": F.col("label_group")})
    n, ids = out.agg(F.count("*"), F.countDistinct("id")).first()
    if n != ids:
        raise ValueError("posting ids collide")
    return out


def split_frame(spark: SparkSession, config: dict, name: str) -> DataFrame:
    listings = tables.load_listings(spark, config["data"]["csv"]).withColumn("id", F.col("posting_id"))
    split = tables.read_split(spark, config["data"]["split"]).withColumnRenamed("posting_id", "id")
    return numbered(splits.with_split(listings, split, name).drop("id"))


def score(found: DataFrame, pool: DataFrame, threshold: float | None, min_matches: int = 0, relative: float = 0.0, k: int = 50) -> dict:
    """Metrics of self-free candidates; without a threshold it is tuned. Undefined ones are NaN."""
    matches = lists.labelled(found, pool.select("id", "label")).persist()
    truth = metrics.group_sizes(pool).persist()
    one = lambda df: next(iter(df.first()))
    out: dict = {"curve": None}
    if threshold is None:
        curve = metrics.f1_curve(matches, truth, min_matches=min_matches, relative=relative).orderBy("threshold").persist()
        threshold = metrics.tune_threshold(curve).first()["threshold"]
        rows = curve.collect()  # a row per grid point
        out["curve"] = {"thresholds": [r["threshold"] for r in rows], "mean_f1": [round(r["mean_f1"], 5) for r in rows]}
    out |= {
        "recall@10": one(metrics.recall_at_k(matches, truth, 10)), "recall@50": one(metrics.recall_at_k(matches, truth, 50)) if k >= 50 else float("nan"),
        "mrr": one(metrics.mrr(matches, truth)), "threshold": threshold,
        "f1": one(metrics.f1_per_listing(matches, truth, threshold, min_matches, relative).agg(F.avg("f1"))),
        "precision@recall0.9": one(metrics.precision_at_recall(matches, truth, 0.9)),
    }
    matches.unpersist()
    truth.unpersist()
    return out


def latencies(search, pool: DataFrame, queries: DataFrame, k: int, n: int, seed: int = 0) -> list[float]:
    """Seconds of single-query searches, for ``n`` queries that a seeded hash picks. Includes planning a job each."""
    times = []
    for row in queries.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n).select("id").collect():
        began = time.perf_counter()
        search(pool, queries.where(F.col("id") == row["id"]), k).collect()
        times.append(time.perf_counter() - began)
    return times


def run(spark: SparkSession, config: dict, split: str, results: str, unlock_test: bool = False) -> dict:
    """Evaluate a configuration on a split: queries are its listings, the pool adds the distractor splits.

    The val split tunes the threshold; the test split needs unlocking and takes val's threshold.
    """
    if split == "test" and not unlock_test:
        raise PermissionError("test listings stay closed until unlock_test is given")
    options = {"k": 50, "latency_sample": 5, "min_matches": 0, "relative": 0.0, "distractors": []} | config.get("eval", {})
    if split in options["distractors"] or "test" in options["distractors"]:
        raise ValueError("neither test listings nor the queries' own split can distract")
    k = int(options["k"])
    queries = split_frame(spark, config, split)
    began = time.perf_counter()
    pool = lists.pool(queries, *[split_frame(spark, config, d) for d in options["distractors"]]).persist()
    size = pool.count()
    fit_s = time.perf_counter() - began
    asked = pool.where("is_query").drop("is_query")
    search = build(config["retriever"])
    found = lists.drop_self(search(pool, asked, k + 1), k).persist()
    threshold = None if split == "val" else tables.load_threshold(results, config["name"])
    scored = score(found, pool, threshold, int(options["min_matches"]), float(options["relative"]), k)
    curve = scored.pop("curve")
    times = latencies(search, pool, asked, k + 1, int(options["latency_sample"]))
    usd = float(config.get("cost", {}).get("usd_per_hour", 0.10))
    speed = {"p50_ms": float("nan"), "p95_ms": float("nan"), "usd_per_1k_queries": float("nan")}
    if times:
        speed = metrics.latency_percentiles(spark.createDataFrame([(t,) for t in times], "seconds double"), usd).first().asDict()
    record = {
        "timestamp": sinks.now(), "name": config["name"], "rung": config.get("rung", ""), "split": split, "git_sha": sinks.git_sha(), "config": config,
        "metrics": {"n_queries": asked.count(), "pool_size": size, **scored, **speed, "fit_s": fit_s}, "threshold_curve": curve,
    }
    sinks.write_run(results, record)
    found.unpersist()
    pool.unpersist()
    return record


def train_fusion(spark: SparkSession, config: dict, k: int = 50, fold: str | None = None, folds: str | None = None) -> dict:
    """Fit the fusion weights of a configuration on its train split, or one fold of it, and write the model."""
    table = fusion_config(config["retriever"])
    train = split_frame(spark, config, "train")
    if fold:
        train = train.join(tables.read_folds(spark, folds).where(F.col("fold") == fold), "posting_id", "left_semi")
    train = train.persist()
    members = [build(m)(train, train, k + 1) for m in table["members"]]
    columns = [f"m{n}_{kind}" for n in range(len(members)) for kind in ("score", "inv_rank")]
    model = training.fit_logreg(training.fusion_pairs(members, train.select("id", "label")), columns)
    sinks.write_model(model, table["model_path"])
    return model


def train_judge(spark: SparkSession, pairs: str, scores: str, out: str) -> dict:
    """Fit the reranking judge on exported pairs and their scores, and write the model."""
    own = tables.read_csv(spark, pairs, {"query": "string", "candidate": "string", "base_score": "double", "same": "boolean"})
    given = tables.read_csv(spark, scores, {"query": "string", "candidate": "string", "score": "double"})
    keys = {"query": "query_id", "candidate": "cand_id"}
    rows = training.judge_pairs(own.withColumnsRenamed(keys), given.withColumnsRenamed(keys))
    model = training.fit_logreg(rows, ["base_score", "pair_score"])
    sinks.write_model(model, out)
    return model


def _named(rows: DataFrame, pool: DataFrame) -> DataFrame:
    """Candidate rows with posting ids instead of numbers, as ``query, candidate``."""
    ids = pool.select("id", "posting_id")
    q, c = (ids.withColumnsRenamed({"id": a, "posting_id": b}) for a, b in (("query_id", "query"), ("cand_id", "candidate")))
    both = rows.join(q, "query_id").join(c, "cand_id")
    return both.select("query", "candidate", *[x for x in rows.columns if x not in ("query_id", "cand_id")])


def export(spark: SparkSession, config: dict, out: str, n: int = 20, train_queries: int = 6000, seed: int = 0, folds: str | None = None) -> None:
    """Write the first candidates of val (against val and train) and of train queries (against train) as pairs."""
    search = build(config["retriever"])
    val, train = split_frame(spark, config, "val"), split_frame(spark, config, "train")
    pools = {"val": lists.pool(val, train)}
    if train_queries:
        asked = train.withColumn("_turn", F.xxhash64(F.lit(seed), "id")).orderBy("_turn", "id").limit(train_queries).drop("_turn")
        pools["train"] = lists.pool(asked, train.join(asked, "id", "left_anti"))
    else:
        pools["train"] = lists.pool(train)
    for name, pool in pools.items():
        pool = pool.persist()
        assigned = None
        if name == "train":
            own = tables.read_folds(spark, folds).join(pool.select("id", "posting_id"), "posting_id").select("id", "fold") if folds else None
            assigned = splits.fold_assign(pool.where("is_query"), seed) if own is None else own
        found = search(pool, pool.where("is_query").drop("is_query"), n + 1)
        sinks.write_pairs(_named(training.export_pairs(found, pool.select("id", "label"), n, assigned), pool), out, name)
        pool.unpersist()


def mine(spark: SparkSession, config: dict, out: str, k: int = 20, per_query: int = 5) -> DataFrame:
    """Write the hard negatives of the train split."""
    train = split_frame(spark, config, "train").persist()
    found = training.hard_negatives(build(config["retriever"])(train, train, k + 1), train.select("id", "label"), k, per_query)
    named = _named(found, train)
    named.write.mode("overwrite").csv(f"{out}/upload/hard_negatives", header=True)
    return named
