"""Exact nearest neighbours by a block matrix join with quantised pruning.

Vectors are quantised to signed 8-bit codes with a scale each. A task multiplies a block of query
codes by a block of candidate codes, tile by tile, which gives every inner product up to an error
bound that the quantisation residuals set. Pairs whose upper bound falls below the k-th best lower
bound are out; the others are recomputed from the original vectors in double precision and pushed
on a heap per query. The heaps of a query's blocks are merged at the end, in rounds of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import materialize

#: Numbers in a block, so that rows of a block are these over the dimension.
QUERY_NUMBERS, CANDIDATE_NUMBERS = 1 << 20, 1 << 18
#: Query rows of one tile.
TILE = 256
#: Heaps of one query that a round merges into one.
FAN_IN = 64
#: A null vec_id, as a number that comes after all others.
_NO_ID = 2**63 - 1


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not zero, every component present and finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, dim: int):
    import numpy as np

    flat = column.combine_chunks()
    values = (flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])).to_numpy()
    return np.ascontiguousarray(values.reshape(-1, dim))


def quantise(x):
    """int8 codes, scale, norm of the quantised vector, norm of the residual, norm; per row of ``x`` (float64)."""
    import numpy as np

    scale = np.maximum(np.abs(x).max(axis=1), np.finfo(np.float64).tiny) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    norm = lambda m: np.sqrt(np.einsum("ij,ij->i", m, m))
    return codes, scale, norm(back), norm(x - back), norm(x)


def code_products(a, b):
    """Products of int8 codes, exactly: sums of a few hundred products fit a float's 24 bits."""
    import numpy as np

    step, out = 1024, None
    for at in range(0, a.shape[1], step):
        part = a[:, at : at + step].astype(np.float32) @ b[:, at : at + step].astype(np.float32).T
        out = part.astype(np.float64) if out is None else out + part
    return out


def exact_products(a, b):
    """Row-wise inner products in double precision, summed in order of the components."""
    import numpy as np

    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j].astype(np.float64) * b[:, j].astype(np.float64)
    return total


def block_search(query_rows, queries, rows, ids, vectors, k: int) -> list[list[tuple[float, int]]]:
    """Per query the k best (score, vec_id) of a block, best first, ties to the smaller id; never the query's own row."""
    import numpy as np

    cc, cs, _, cr, cn = quantise(vectors.astype(np.float64))
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_rows]
    for at in range(0, len(query_rows), TILE):
        q = queries[at : at + TILE]
        qc, qs, qh, qr, _ = quantise(q.astype(np.float64))
        about = code_products(qc, cc) * qs[:, None] * cs[None, :]
        # q.c = q'.c' + q'.(c - c') + (q - q').c, and a little for rounding.
        error = (qh[:, None] * cr[None, :] + qr[:, None] * cn[None, :]) * (1 + 1e-9) + 1e-12 * (qh + qr)[:, None] * cn[None, :]
        own = query_rows[at : at + TILE, None] == rows[None, :]
        about[own] = -np.inf
        lower = about - error
        if lower.shape[1] > k:
            floor = np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]
            keep = about + error >= floor[:, None]
        else:
            keep = np.ones_like(own)
        i, j = np.nonzero(keep & ~own)
        for lo in range(0, len(i), 1 << 16):
            a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            scores = exact_products(q[a], vectors[b])
            for n, s, c in zip((a + at).tolist(), scores.tolist(), ids[b].tolist(), strict=True):
                if len(heaps[n]) < k:
                    heapq.heappush(heaps[n], (s, -c))
                elif (s, -c) > heaps[n][0]:
                    heapq.heapreplace(heaps[n], (s, -c))
    return [[(s, -c) for s, c in sorted(h, reverse=True)] for h in heaps]


def _blocks(n: int, numbers: int) -> Column:
    """How many blocks of about ``numbers`` numbers ``n`` vectors of a dimension make."""
    return F.greatest(F.lit(1), F.ceil(F.lit(float(n)) * F.col("dim") / numbers)).cast("int")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest inner product with each query row.

    Candidates are all rows with usable vectors of the query's dimension but the query's own row. Rows that repeat
    a vec_id are rows of their own, as queries and as candidates, so such a vec_id has several lists, or stands in a list more
    than once. A row without a vec_id is a candidate, told as null, behind all others of its score, and asks if
    ``is_query`` says so. Fewer than k candidates: all of them. Empty tables give empty results; other columns are
    ignored. Ties go to the smaller vec_id.
    """
    valid = vectors.where(usable(F.col("embedding"))).select(F.coalesce("vec_id", F.lit(_NO_ID)).cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("_asks"))
    # Numbers of rows, which hold once the table is written.
    rows = materialize(valid.withColumns({"dim": F.size("embedding"), "row": F.monotonically_increasing_id()}), "vectors")
    n, asking, most = rows.agg(F.count("*"), F.count_if("_asks"), F.coalesce(F.max("dim"), F.lit(0))).first()
    q_blocks, c_blocks = _blocks(asking, QUERY_NUMBERS), _blocks(n, CANDIDATE_NUMBERS)
    own = lambda blocks: F.pmod(F.xxhash64("row"), blocks).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    # A query row goes to each candidate block once, and the other way round; blocks are of bounded size.
    left = rows.where("_asks").select("row", "vec_id", "embedding", "dim", own(q_blocks).alias("qb"), every(c_blocks).alias("cb"))
    # Both sides come from one table, so every column gets a name, and an identity, of its side.
    named = [F.col(c).alias(f"c_{c}") for c in ("row", "vec_id", "embedding", "dim")]
    right = rows.select(*named, every(q_blocks).alias("c_qb"), own(c_blocks).alias("c_cb"))
    found = "row long, query_id long, cb int, near array<struct<score:double,vec_id:long>>"
    near = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))

    def search(key, q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "cb": pa.array([], pa.int32()), "near": pa.array([], near)})
        dim = key[0].as_py()
        asked = q["row"].to_numpy()
        best = block_search(asked, _matrix(q["embedding"], dim), c["c_row"].to_numpy(), c["c_vec_id"].to_numpy(), _matrix(c["c_embedding"], dim), k)
        lists = pa.array([[{"score": s, "vec_id": v} for s, v in b] for b in best], near)
        return pa.table({"row": pa.array(asked), "query_id": q["vec_id"], "cb": pa.array([key[2].as_py()] * len(asked), pa.int32()), "near": lists})

    met = left.groupBy("dim", "qb", "cb").cogroup(right.groupBy("c_dim", "c_qb", "c_cb"))
    lists = met.applyInArrow(search, found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(3):
                heaps = [[(-x["score"], x["vec_id"]) for x in part] for part in parts.as_py()]
                out.append([{"score": -s, "vec_id": v} for s, v in islice(heapq.merge(*heaps), k)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, near)], names=["row", "query_id", "cb", "near"])

    # Each round merges up to FAN_IN heaps of a query; the next one merges what is left.
    left_over = max(1, -(-n * most // CANDIDATE_NUMBERS))
    while left_over > 1:
        left_over = -(-left_over // FAN_IN)
        together = lists.groupBy("row", "query_id", F.floor(F.col("cb") / FAN_IN).cast("int").alias("cb")).agg(F.collect_list("near").alias("near"))
        lists = together.mapInArrow(merge, found)
    ranked = lists.select("query_id", F.posexplode("near").alias("_at", "_hit"))
    no_id = F.lit(_NO_ID)
    return ranked.select(
        F.nullif("query_id", no_id).alias("query_id"), (F.col("_at") + 1).cast("int").alias("rank"),
        F.nullif(F.col("_hit.vec_id"), no_id).alias("vec_id"), F.col("_hit.score").alias("score"),
    )
