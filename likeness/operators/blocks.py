"""All queries against all candidates, block by block.

Rows are dealt to blocks of bounded size; each query block meets each candidate block in one task, and a
compare function sees two whole blocks at a time. Nothing is broadcast, and no pair is materialised
that the function does not return.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

QUERY_ROWS, CANDIDATE_ROWS, MOST_PARTS = 8192, 4096, 4096


def block_join(
    queries: DataFrame, candidates: DataFrame, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
    query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS, *counts: int,
) -> DataFrame:
    """Rows that ``compare`` returns of each pair of blocks. Both sides need ``id`` and ``value``; ``counts`` are their rows, if known."""
    counts = counts or (queries.count(), candidates.count())
    n_q, n_c = (max(1, -(-n // rows)) for n, rows in zip(counts, (query_rows, candidate_rows), strict=True))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Both sides may come from one table, so every column gets a name, and an identity, of its side.
    named = lambda df, x, q, c: df.select(
        F.col("id").alias(f"{x}_id"), F.col("value").alias(f"{x}_value"), q.alias(f"{x}_qb"), c.alias(f"{x}_cb")
    )
    left, right = named(queries, "q", deal(n_q), every(n_c)), named(candidates, "c", every(n_q), deal(n_c))

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        plain = lambda t: pa.table({"id": t.column(0), "value": t.column(1)})
        if not q.num_rows or not c.num_rows:
            return none
        return compare(plain(q), plain(c))

    none = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    # As many partitions as pairs of blocks: small blocks may take long to compare, so they are not put together by their bytes.
    n = min(n_q * n_c, MOST_PARTS)
    left, right = left.repartition(n, "q_qb", "q_cb"), right.repartition(n, "c_qb", "c_cb")
    return left.groupBy("q_qb", "q_cb").cogroup(right.groupBy("c_qb", "c_cb")).applyInArrow(run, schema)
