"""The library's operators as named queries over the tables of a folder.

The tables hold no catalogue, so parts stand in for listings: a part's brand, name and size are its
title, the vector of the same number is its picture's vector, the vector's signs its perceptual hash,
and the vector's label its product.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.functions.text import decode_title, tokens
from likeness.functions.vectors import sign_hash
from likeness.operators import bm25, dense, fusion, hashes, metrics, splits, training
from likeness.operators import candidates as lists

K, RADIUS, EXPAND = 50, 18, 3
#: Weights of the fusion query: score and inverse rank of titles, then of vectors. Of the judge: base score, pair score.
FUSION = ([2.25, -0.5, 4.5, 0.75], -3.0)
JUDGE = ([3.0, 1.5], -1.25)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, title`` of all parts."""
    title = F.concat_ws(" ", "p_brand", "p_name", F.col("p_size").cast("string"), F.lit("ml"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), title.alias("title"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, embedding, label``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("long").alias("label"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, title, embedding, hash, label`` of parts that have a vector."""
    both = titles(spark, sf_dir).join(vectors(spark, sf_dir), "id")
    return both.withColumn("hash", sign_hash(F.col("embedding")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))


def r9(c: str | Column, name: str | None = None) -> Column:
    return F.round(c, 9).alias(name or c)


# --- text and inverted index -------------------------------------------------------------------


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = documents(spark, sf_dir).select("id", tokens(F.col("title")).alias("t"))
    return t.select(F.col("id").alias("doc_id"), F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


def canonical_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select(F.col("id").alias("p_partkey"), F.array_join(tokens(F.col("title"), True), " ").alias("tokens"))


def decode_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode_title(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(decoded).cast("long").alias("n_chars"), F.md5(decoded).alias("digest"))


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.build(documents(spark, sf_dir)).stats.select("term", "df", "cf", r9("idf"))


def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.build(documents(spark, sf_dir)).postings.select(F.col("id").alias("doc_id"), "term", "tf", "dl", r9("w"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    return bm25.search(bm25.build(rows), rows, K + 1)


def bm25_topk_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bm25_topk, over all parts; the SQL of bm25_topk covers those that have a vector."""
    rows = titles(spark, sf_dir)
    return bm25.search(bm25.build(rows), rows, K + 1)


def bm25_self_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = titles(spark, sf_dir)
    return bm25.self_scores(bm25.build(rows), rows).select("query_id", r9("self_score"))


def bm25_benchmark_vs_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("title"))
    return bm25.search(bm25.build(documents(spark, sf_dir)), items, K)


# --- vectors and hashes ------------------------------------------------------------------------


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return dense.search(rows, rows, K + 1)


def cosine_topk_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return dense.search(rows, rows, K + 1, find=dense.approximate)


def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many neighbours there are, and whether the inverted file finds nine in ten of them."""
    true = cosine_topk(spark, sf_dir).select("query_id", "cand_id", F.lit(1).alias("true"))
    found = cosine_topk_ivf(spark, sf_dir).select("query_id", "cand_id", F.lit(1).alias("found"))
    both = true.join(found, ["query_id", "cand_id"], "left")
    return both.agg(F.count("*").alias("neighbours"), (F.count("found") >= 0.9 * F.count("*")).alias("nine_in_ten"))


def neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first components of the voted vectors, which a search would hide behind ranks."""
    rows = vectors(spark, sf_dir)
    voted = dense.vote(rows, rows, EXPAND)
    return voted.select("id", r9(F.get("embedding", F.lit(0)), "x0"), r9(F.get("embedding", F.lit(63)), "x63"))


def knn_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return dense.search(rows, rows, K + 1, EXPAND)


def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", sign_hash(F.col("embedding")).alias("hash"))
    return hashes.hamming_join(rows, rows, RADIUS)


def phash_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    return hashes.boost(bm25.search(bm25.build(rows), rows, K + 1), hashes.hamming_join(rows, rows, RADIUS), K + 1)


def phash_boost_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As phash_boost, over all parts; those without a vector have no hash and get no boost."""
    found = vectors(spark, sf_dir).select("id", sign_hash(F.col("embedding")).alias("hash"))
    rows = titles(spark, sf_dir).join(found, "id", "left")
    return hashes.boost(bm25.search(bm25.build(rows), rows, K + 1), hashes.hamming_join(rows, rows, RADIUS), K + 1)


# --- fusion and reranking ----------------------------------------------------------------------


def _members(rows: DataFrame, k: int) -> list[DataFrame]:
    return [bm25.search(bm25.build(rows), rows, k), dense.search(rows, rows, k)]


def fusion_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fusion.features(_members(listings(spark, sf_dir), K + 1))
    return found.select("query_id", "cand_id", "m0_score", r9("m0_inv_rank"), "m1_score", r9("m1_inv_rank"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(_members(listings(spark, sf_dir), K + 1), K + 1)


def learned_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.learned(_members(listings(spark, sf_dir), K + 1), K + 1, *FUSION)


def _overlap(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The share of title tokens in common, as the pair score that a judge model would give."""
    own = rows.select("id", F.array_distinct(tokens(F.col("title"))).alias("t"))
    q, c = own.select(F.col("id").alias("query_id"), F.col("t").alias("qt")), own.select(F.col("id").alias("cand_id"), F.col("t").alias("ct"))
    both = pairs.select("query_id", "cand_id").join(q, "query_id").join(c, "cand_id")
    return both.select("query_id", "cand_id", (F.size(F.array_intersect("qt", "ct")) / F.size(F.array_union("qt", "ct"))).alias("score"))


def rerank_by_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    base = dense.search(rows, rows, K + 1)
    return fusion.rerank(base, _overlap(base.where("query_id <> cand_id"), rows), K + 1, *JUDGE)


# --- lists, decisions, metrics -----------------------------------------------------------------


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, truth, pool) of the cosine lists of all vectors against all."""
    rows = vectors(spark, sf_dir)
    pool = rows.withColumn("is_query", F.lit(True))
    matches = lists.labelled(lists.drop_self(dense.search(rows, rows, K + 1), K), rows.select("id", "label"))
    return matches, metrics.group_sizes(pool), pool


def drop_self_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return lists.drop_self(dense.search(rows, rows, K + 1), K)


def match_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)[0]


def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)[1]


def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, truth, _ = _found(spark, sf_dir)
    rows = [metrics.recall_at_k(matches, truth, k).select(F.lit(k).cast("long").alias("k"), r9("recall")) for k in (10, 50)]
    return rows[0].unionByName(rows[1])


def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mrr(*_found(spark, sf_dir)[:2]).select(r9("mrr"))


def _f1(spark: SparkSession, sf_dir: str, **rule) -> DataFrame:
    return metrics.f1_per_listing(*_found(spark, sf_dir)[:2], 0.4, **rule).select("query_id", r9("f1"))


def f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _f1(spark, sf_dir)


def f1_min_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _f1(spark, sf_dir, min_matches=1)


def f1_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _f1(spark, sf_dir, min_matches=1, relative=0.8)


def floor_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.floor_f1(_found(spark, sf_dir)[1]).select("query_id", r9("f1"))


def f1_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, truth, _ = _found(spark, sf_dir)
    return metrics.f1_curve(matches, truth, min_matches=1, relative=0.8).select("threshold", r9("mean_f1"))


def tune_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, truth, _ = _found(spark, sf_dir)
    return metrics.tune_threshold(metrics.f1_curve(matches, truth)).select("threshold", r9("f1"))


def precision_at_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, truth, _ = _found(spark, sf_dir)
    return metrics.precision_at_recall(matches, truth, 0.05).select(r9("precision"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = table(spark, sf_dir, "events").select((F.col("value") / 1000).alias("seconds"))
    return metrics.latency_percentiles(times).select(r9("p50_ms"), r9("p95_ms"), r9("usd_per_1k_queries"))


def pool_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", "label")
    split = splits.group_split(rows)
    of = lambda name: rows.join(split.where(F.col("split") == name), "id", "left_semi")
    return lists.pool(of("val"), of("train"))


# --- splits, mining, training data -------------------------------------------------------------


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.group_split(_products(spark, sf_dir))


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _products(spark, sf_dir)
    return splits.split_counts(rows, splits.group_split(rows))


def fold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.fold_assign(_products(spark, sf_dir))


def coverage_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.uncovered(titles(spark, sf_dir).select("id"), vectors(spark, sf_dir).select("id"))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return training.hard_negatives(dense.search(rows, rows, 21), rows.select("id", "label"))


def pair_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    labels = rows.select("id", "label")
    return training.export_pairs(dense.search(rows, rows, 21), labels, 20, splits.fold_assign(labels))


def captured_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = _found(spark, sf_dir)[1]
    return training.captured_share(pair_export(spark, sf_dir), truth).select(r9("share"))


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.triplets(vectors(spark, sf_dir).select("id", "label"), hard_negatives(spark, sf_dir))


def title_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.jaccard_pairs(titles(spark, sf_dir)).select("a", "b", r9("jaccard"))


def fusion_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    pairs = training.fusion_pairs(_members(rows, K + 1), rows.select("id", "label"))
    model = training.fit_logreg(pairs, ["m0_score", "m0_inv_rank", "m1_score", "m1_inv_rank"])
    named = [*zip(model["features"], model["coef"], strict=True), ("intercept", model["intercept"])]
    return spark.createDataFrame(named, "feature string, weight double").select("feature", F.round("weight", 4).alias("weight"))


def title_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as idf-weighted means of word vectors; a word's vector here is made of its digest."""
    rows = titles(spark, sf_dir)
    stats = bm25.build(rows, canonical_units=True).stats
    part = lambda i: F.conv(F.substring(F.md5("term"), 1 + 2 * i, 2), 16, 10).cast("double") - 127.5
    words = stats.select("term", F.array(*[part(i) for i in range(4)]).alias("vector"))
    n = rows.agg(F.count("*").alias("n"))
    idf = stats.join(F.broadcast(n), F.lit(True)).select("term", F.log1p(F.col("n") / F.col("df")).alias("idf"))
    found = training.title_vectors(rows, words, idf)
    return found.select("id", *[r9(F.get("embedding", F.lit(i)), f"x{i}") for i in range(4)])


def bootstrap_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gain in F1 by the first candidate, with a resampled interval."""
    matches, truth, _ = _found(spark, sf_dir)
    a, b = metrics.f1_per_listing(matches, truth, 0.4, 1), metrics.f1_per_listing(matches, truth, 0.4)
    diff = a.join(b.withColumnRenamed("f1", "other"), "query_id").select("query_id", (F.col("f1") - F.col("other")).alias("diff"))
    return metrics.bootstrap(diff, 200).select(r9("mean"), r9("low"), r9("high"))


# --- whole pipeline ----------------------------------------------------------------------------


def final_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with canonical units and vectors with voting, fused by learned weights, boosted by hashes, self dropped."""
    rows = listings(spark, sf_dir)
    members = [bm25.search(bm25.build(rows, canonical_units=True), rows, K + 1), dense.search(rows, rows, K + 1, EXPAND)]
    fused = fusion.learned(members, K + 1, *FUSION)
    return lists.drop_self(hashes.boost(fused, hashes.hamming_join(rows, rows, RADIUS), K + 1), K)


def final_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of the final candidates at the tuned threshold, at least one match, near-ties accepted: a row."""
    rows = listings(spark, sf_dir).select("id", "label", F.lit(True).alias("is_query"))
    # Three metrics read the lists; kept in memory or on disk, and recomputed where an executor is lost.
    matches = lists.labelled(final_candidates(spark, sf_dir), rows.select("id", "label")).persist()
    truth = metrics.group_sizes(rows)
    curve = metrics.tune_threshold(metrics.f1_curve(matches, truth, min_matches=1, relative=0.8))
    out = curve.select("threshold", r9("f1"))
    for df in (metrics.recall_at_k(matches, truth, 10).select(r9("recall", "recall_10")), metrics.mrr(matches, truth).select(r9("mrr"))):
        out = out.join(df, F.lit(True))  # a row each
    return out


_ALL = (
    tokenize, canonical_units, decode_titles, term_stats, bm25_postings, bm25_topk, bm25_topk_titles, bm25_self_score, bm25_benchmark_vs_documents,
    cosine_topk, cosine_topk_ivf, ivf_recall, neighbour_votes, knn_expand, hamming_pairs, phash_boost, phash_boost_titles, fusion_features, rrf_fusion, learned_fusion,
    rerank_by_overlap, drop_self_topk, match_flags, group_sizes, recall, mrr, f1_threshold, f1_min_matches, f1_relative, floor_f1, f1_curve,
    tune_threshold, precision_at_recall, latency_percentiles, pool_union, group_split, split_counts, fold_assign, coverage_antijoin,
    hard_negatives, pair_export, captured_share, triplets, title_jaccard_pairs, fusion_logreg, title_vectors, bootstrap_gain,
    final_candidates, final_pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}
