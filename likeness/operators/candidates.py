"""Candidate lists: ``query_id, cand_id, score, rank``, rank from 1; what is absent has no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores are compared after rounding to so many places, and ties go to the smaller candidate.
PLACES = 9


def top_k(scored: DataFrame, k: int, *then: Column) -> DataFrame:
    """The ``k`` best of each query by rounded score, then by ``then``, then by candidate."""
    scored = scored.withColumn("score", F.round("score", PLACES))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *then, F.col("cand_id").asc())
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "cand_id", "score", "rank")


def first(candidates: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each list as they are ranked, numbered anew."""
    order = Window.partitionBy("query_id").orderBy("rank", "cand_id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "cand_id", "score", "rank")


def drop_self(candidates: DataFrame, k: int) -> DataFrame:
    """Each query out of its own list, which closes up and ends at ``k``."""
    return first(candidates.where("query_id <> cand_id"), k)


def labelled(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """``candidates`` with ``is_match``: whether the two have the same label. ``labels``: id, label."""
    q = labels.select(F.col("id").alias("query_id"), F.col("label").alias("_ql"))
    c = labels.select(F.col("id").alias("cand_id"), F.col("label").alias("_cl"))
    both = candidates.join(q, "query_id").join(c, "cand_id")
    return both.withColumn("is_match", F.col("_ql") == F.col("_cl")).drop("_ql", "_cl").select(*candidates.columns, "is_match")


def pool(queries: DataFrame, *distractors: DataFrame) -> DataFrame:
    """Queries and distractors in one table, told apart by ``is_query``."""
    out = queries.withColumn("is_query", F.lit(True))
    for d in distractors:
        out = out.unionByName(d.withColumn("is_query", F.lit(False)))
    return out
