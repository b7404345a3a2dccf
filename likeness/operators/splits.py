"""Splits and folds that keep the listings of a product together."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def group_split(listings: DataFrame, fractions: tuple[float, ...] = (0.7, 0.1, 0.2), seed: int = 42) -> DataFrame:
    """``id, split``: groups (label) in the order of a seeded hash, cut at the fractions of their number.

    The order is taken by hash prefix first, so that ranking the groups is not one task's work.
    """
    if not math.isclose(sum(fractions), 1.0, rel_tol=1e-5):
        raise ValueError("the shares of the splits have to add up to one")
    turn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("label").cast("string")))
    groups = listings.select("label").distinct().withColumn("turn", turn).withColumn("part", F.substring("turn", 1, 3))
    parts = groups.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.sum("n").over(Window.partitionBy()).alias("total"))
    placed = groups.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("turn", "label"))).join(parts, "part")
    nth, total = F.col("nth") + F.col("n0"), F.col("total")
    train, val = F.rint(total * fractions[0]), F.rint(total * fractions[1])
    split = F.when(nth <= train, "train").when(nth <= train + val, "val").otherwise("test")
    return listings.select("id", "label").join(placed.select("label", split.alias("split")), "label").select("id", "split")


def split_counts(listings: DataFrame, split: DataFrame) -> DataFrame:
    """``split, listings, groups``."""
    rows = listings.select("id", "label").join(split, "id")
    return rows.groupBy("split").agg(F.count("*").alias("listings"), F.countDistinct("label").alias("groups"))


def fold_assign(listings: DataFrame, seed: int = 0) -> DataFrame:
    """``id, fold``: A or B by a hash of the group, so no group is in both."""
    digit = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"fold{seed}"), F.col("label").cast("string"))), 1, 1), 16, 10).cast("int")
    return listings.select("id", F.when(digit < 8, "A").otherwise("B").alias("fold"))


def uncovered(listings: DataFrame, split: DataFrame) -> DataFrame:
    """Listings that the split does not name."""
    return listings.join(split, "id", "left_anti")


def with_split(listings: DataFrame, split: DataFrame, name: str) -> DataFrame:
    """Listings of one split; ValueError for an unknown split, a listing not covered, or an id that is not unique."""
    if name not in SPLITS:
        raise ValueError(f"no split is called {name!r}")
    for side, df in (("listings", listings), ("split", split)):
        if df.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError(f"repeated ids among the {side}")
    if uncovered(listings, split).limit(1).count():
        raise ValueError("some listings are in no split")
    return listings.join(split, "id").where(F.col("split") == name).drop("split")
