"""Connected components of a graph given as an edge table, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import drop_table, materialize


#: Groups of so few rows in all are broadcast as a whole: two or three numbers each.
SMALL_ROWS = 200_000
#: Beyond, a key is hot if it holds more than a thousandth of all rows, and more than so many.
HOT_ROWS = 1000


def hot_join(rows: DataFrame, groups: DataFrame, key: str, n_rows: int) -> DataFrame:
    """``rows``, ``n_rows`` of them, with what ``groups`` (a row per key, with ``n``, the key's number of rows) says of their key.

    There are no more groups than rows, so few rows have few groups, which are broadcast. Of many, the hot keys, a
    thousand at most, are broadcast, so their rows stay where they are, and the rest is shuffled. ``n`` is left out.
    """
    if n_rows <= SMALL_ROWS:
        return rows.join(F.broadcast(groups.drop("n")), key)
    hot = F.col("n") > max(HOT_ROWS, n_rows // 1000)
    few, rest = F.broadcast(groups.where(hot).drop("n")), groups.where(~hot).drop("n")
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(rest, key))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node ties its larger neighbours to its smallest neighbour, itself included."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
    return hot_join(both.where(F.col("b") > F.col("a")), least, "a", 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node ties its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    own = least.select("a", F.col("m").alias("b"))
    return hot_join(down, least, "a", n).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (a, b long): root is the smallest node it reaches.

    Loops and repeated edges change nothing; nodes without an edge to another node are left out. Each
    star is written to the shared folder, so a lost executor costs one at most; tables are removed as the next is
    written. The driver sees one checksum a round.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        starred = materialize(_large_star(now, before[0]).where("a <> b").distinct(), "cc")
        after = materialize(_small_star(starred, before[0]).where("a <> b").distinct(), "cc")
        for done in (now, starred):
            drop_table(done)
        now, then = after, before
        before = mark(now)
        if before == then:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
