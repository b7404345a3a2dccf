"""Nearest neighbours of precomputed vectors, and neighbour voting."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.functions.vectors import l2_normalise
from likeness.operators.blocks import block_join
from likeness.operators.candidates import PLACES, top_k

_HITS = "query_id long, cand_id long, score double"
#: Lists of the inverted file, rows that its centres are fitted on, rows of a list that lie together, queries that its probes are planned on.
MOST_CENTRES, SAMPLE_ROWS, PART_ROWS, PLANNED = 4096, 50_000, 4096, 200


def look_up(frame: DataFrame, vectors: DataFrame) -> DataFrame:
    """``id, embedding`` of each row of ``frame`` (id); raises KeyError if some have no vector."""
    missing = frame.join(vectors, "id", "left_anti")
    n = missing.count()
    if n:
        raise KeyError(f"no vector for {n} rows; one of them is {missing.first()['id']}")
    return frame.select("id").join(vectors.select("id", "embedding"), "id")


def _matrix(column: pa.ChunkedArray):
    import numpy as np

    rows = column.combine_chunks()
    rows = pa.concat_arrays(rows.chunks) if isinstance(rows, pa.ChunkedArray) else rows
    return rows.flatten().to_numpy().astype(np.float64).reshape(len(rows), -1)


def _compare(k: int):
    """A function that yields all of two blocks that may be among the k best of each query: ties and the last places' rounding included."""

    def compare(q: pa.Table, c: pa.Table) -> pa.Table:
        import numpy as np

        a, b, ids, own = _matrix(q["value"]), _matrix(c["value"]), c["id"].to_numpy(), q["id"].to_numpy()
        out = [[], [], []]
        width = min(k, len(ids))
        for at in range(0, len(a), 256):
            about = a[at : at + 256] @ b.T
            floor = np.partition(about, about.shape[1] - width, axis=1)[:, about.shape[1] - width]
            i, j = np.nonzero(about >= floor[:, None] - 10.0**-PLACES)
            score = np.zeros(len(i))
            for d in range(a.shape[1]):  # in order of the components, as a fold would
                score += a[at + i, d] * b[j, d]
            for part, x in zip(out, (own[at + i], ids[j], score), strict=True):
                part.append(x)
        return pa.table(dict(zip(("query_id", "cand_id", "score"), map(np.concatenate, out), strict=True)))

    return compare


def exact(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest by inner product, both sides ``id, embedding``. Fewer where the corpus is smaller."""
    value = F.col("embedding").alias("value")
    hits = block_join(queries.select("id", value), corpus.select("id", value), _compare(k), _HITS)
    return top_k(hits, k)


def _centres(corpus: DataFrame, n: int, seed: int):
    """Centres of about 2 sqrt(n) lists, MOST_CENTRES at most, by k-means over at most SAMPLE_ROWS rows of lowest hash."""
    import numpy as np

    rows = corpus.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE_ROWS).select("embedding").toPandas()
    x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[: min(len(x), MOST_CENTRES, max(1, int(2 * n**0.5)))].copy()
    for _ in range(8):
        of = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        filled = np.bincount(of, minlength=len(centres)) > 0
        centres[filled] = sums[filled] / np.maximum(np.linalg.norm(sums[filled], axis=1, keepdims=True), 1e-12)
    return centres


def approximate(queries: DataFrame, corpus: DataFrame, k: int, recall: float = 0.97, seed: int = 7) -> DataFrame:
    """The ``k`` nearest by an inverted file: vectors lie in lists around centres, a query looks into the lists nearest to it.

    How many lists are looked into is planned: for PLANNED of the queries the true neighbours are found, and the
    number is the least that reaches ``recall`` over them. Lists are cut into parts of bounded size. Vectors that are null take
    no part. What comes to the driver: centres, and the places of the planned queries' neighbours.
    """
    import numpy as np

    queries, corpus = (df.where(F.col("embedding").isNotNull()).select("id", "embedding") for df in (queries, corpus))
    n = corpus.count()
    if not n:
        return queries.sparkSession.createDataFrame([], f"{_HITS}, rank int")
    centres = _centres(corpus, n, seed)

    def lists(most: int):
        """The numbers of the ``most`` lists nearest to each vector, nearest first."""

        @F.pandas_udf("array<int>")
        def nearest(vectors: pd.Series) -> pd.Series:
            near = np.stack(vectors.to_numpy()).astype(np.float64) @ centres.T
            return pd.Series(list(np.argsort(-near, axis=1, kind="stable")[:, :most].astype(np.int32)))

        return nearest("embedding")

    home = corpus.select("id", "embedding", F.get(lists(1), F.lit(0)).alias("list"))
    planned = queries.orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id").limit(PLANNED)
    truth = exact(planned, corpus, k).join(home.select(F.col("id").alias("cand_id"), "list"), "cand_id")
    order = planned.select(F.col("id").alias("query_id"), lists(len(centres)).alias("order"))
    places = truth.join(order, "query_id").select(F.array_position("order", F.col("list")).alias("place")).toPandas()["place"].to_numpy()
    probes = int(np.quantile(places, recall, method="higher")) if len(places) else 1
    # A list's part meets every query that looks into the list; parts have about PART_ROWS rows.
    parts = home.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    asked = queries.select(F.col("id").alias("q_id"), F.col("embedding").alias("q_value"), F.explode(lists(probes)).alias("list"))
    asked = asked.join(F.broadcast(parts), "list").select("q_id", "q_value", F.col("list").alias("q_list"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q_part"))
    held = home.join(F.broadcast(parts), "list").select(
        F.col("id").alias("c_id"), F.col("embedding").alias("c_value"), F.col("list").alias("c_list"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("c_part")
    )
    compare, none = _compare(k), pa.table({"query_id": pa.array([], pa.int64()), "cand_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return none
        return compare(*[pa.table({"id": t.column(0), "value": t.column(1)}) for t in (q, c)])

    hits = asked.groupBy("q_list", "q_part").cogroup(held.groupBy("c_list", "c_part")).applyInArrow(run, _HITS)
    return top_k(hits, k)


#: What a configuration may call a vector store. The exact ones differ in nothing but their name.
STORES = {"numpy": exact, "exact": exact, "flat": exact, "qdrant": exact, "hnsw": approximate, "ivf": approximate}


def store(config: dict | None):
    """The search function of a store's configuration: ``type`` and, for faiss, ``index``."""
    config = config or {"type": "numpy"}
    kind = config.get("index", "flat") if config["type"] == "faiss" else config["type"]
    if kind not in STORES:
        raise ValueError(f"no vector store is called {kind!r}; there are {sorted(STORES)}")
    return STORES[kind]


def vote(vectors: DataFrame, corpus: DataFrame, k: int, alpha: float = 3.0) -> DataFrame:
    """Each of ``vectors`` replaced by the weighted mean of its ``k`` nearest in ``corpus``, itself included if there.

    Weights are the similarity to the power ``alpha``, nothing below zero; the mean has length 1.
    """
    near = exact(vectors, corpus, k)
    weight = F.pow(F.greatest(F.col("score"), F.lit(0.0)), F.lit(alpha))
    parts = near.select(F.col("query_id").alias("id"), F.col("cand_id"), weight.alias("w"))
    terms = parts.join(corpus.select(F.col("id").alias("cand_id"), "embedding"), "cand_id")
    terms = terms.select("id", "w", F.posexplode("embedding").alias("at", "x"))
    sums = terms.groupBy("id", "at").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("x"))
    lists = sums.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))
    return lists.select("id", l2_normalise(F.transform("v", lambda p: p["x"])).alias("embedding"))


def search(queries: DataFrame, corpus: DataFrame, k: int, expand_k: int = 0, expand_alpha: float = 3.0, find=exact) -> DataFrame:
    """Candidates by cosine of unit vectors, 1 at most; with ``expand_k`` after voting on both sides.

    Voted vectors are kept in memory or on disk, as they are counted before they are dealt to blocks.
    """
    if expand_k:
        # Both sides vote among the corpus as it was, never twice; what is one table votes once.
        voted = vote(corpus, corpus, expand_k, expand_alpha).persist()
        queries, corpus = voted if queries is corpus else vote(queries, corpus, expand_k, expand_alpha).persist(), voted
    found = find(queries, corpus, k)
    return found.withColumn("score", F.least("score", F.lit(1.0)))
