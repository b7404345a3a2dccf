"""BM25 by an inverted index, searched block by block."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likeness.functions.text import tokens
from likeness.functions.vectors import bm25_weight, lucene_idf, safe_divide
from likeness.operators.blocks import block_join
from likeness.operators.candidates import PLACES, top_k

#: Bags of a block of queries and of candidates, and terms that a block has in all.
QUERY_ROWS, BLOCK_ROWS, BLOCK_TERMS = 2048, 16384, 2_000_000
#: Texts of a partition of the kept bags, where there are more partitions than the cluster works on at once.
PART_ROWS = 10_000
#: Blocks of so few bags times different terms are compared as matrices, so many query bags at a time.
MATRIX_CELLS, MATRIX_ROWS = 8_000_000, 256


def term_counts(docs: DataFrame, canonical_units: bool = False) -> DataFrame:
    """``id, term, tf`` of ``docs`` (id, title)."""
    terms = docs.select("id", F.explode(tokens(F.col("title"), canonical_units)).alias("term"))
    return terms.groupBy("id", "term").agg(F.count("*").alias("tf"))


@dataclass(frozen=True)
class Index:
    """Postings ``id, term, tf, dl, w``, term statistics ``term, df, idf``, and the corpus's constants; ``corpus`` is what it was built of."""

    postings: DataFrame
    stats: DataFrame
    constants: DataFrame
    k1: float
    b: float
    canonical_units: bool
    corpus: DataFrame | None = None


def build(corpus: DataFrame, k1: float = 1.2, b: float = 0.75, canonical_units: bool = False) -> Index:
    """Index ``corpus`` (id, title). The mean length counts documents without tokens, and is 1e-9 at least."""
    counts = term_counts(corpus, canonical_units)
    n = corpus.agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    # One row each, so this join is a product of two scalars.
    constants = n.join(total, F.lit(True)).select(
        "n", F.greatest(F.lit(1e-9), F.col("total").cast("double") / F.greatest(F.col("n"), F.lit(1))).alias("avgdl")
    )
    stats = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    stats = stats.join(F.broadcast(constants), F.lit(True)).select("term", "df", "cf", lucene_idf(F.col("n"), F.col("df")).alias("idf"))
    lengths = counts.groupBy("id").agg(F.sum("tf").alias("dl"))
    weighed = counts.join(lengths, "id").join(stats.select("term", "idf"), "term").join(F.broadcast(constants.select("avgdl")), F.lit(True))
    weight = bm25_weight(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return Index(weighed.select("id", "term", "tf", "dl", weight.alias("w")), stats, constants, k1, b, canonical_units, corpus)


def _known(index: Index, queries: DataFrame) -> DataFrame:
    """``id, term, own``: the terms that the index knows, with the weight each has in its query as if that were a document."""
    counts = term_counts(queries, index.canonical_units).join(index.stats.select("term", "idf"), "term")
    lengths = counts.groupBy("id").agg(F.sum("tf").alias("dl"))
    rows = counts.join(lengths, "id").join(F.broadcast(index.constants.select("avgdl")), F.lit(True))
    return rows.select("id", "term", bm25_weight(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"), index.k1, index.b).alias("own"))


def self_scores(index: Index, queries: DataFrame) -> DataFrame:
    """``query_id, self_score``: each query's score as if it were a document; unknown terms play no part."""
    return _known(index, queries).groupBy(F.col("id").alias("query_id")).agg(F.sum("own").alias("self_score"))


def _bags(rows: DataFrame, weight: str) -> DataFrame:
    """``id, bag``: each text's terms and weights, in order of the terms."""
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", F.col(weight).alias("w")))).alias("bag"))


def _blocks(bags: DataFrame, most: int) -> tuple[int, int]:
    """How many bags there are, and the rows of a block: ``most``, fewer where bags are long."""
    n, terms = bags.agg(F.count("*"), F.sum(F.size("value.terms"))).first()
    return n, max(1, min(most, BLOCK_TERMS * n // max(1, terms or 0)))


def _nth(values, k: int) -> float:
    """The ``k``-th largest, or 0 if there are fewer."""
    import numpy as np

    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else 0.0


def _products(k: int, queries, candidates, n_terms: int):
    """``(query, candidate, score)`` of each query bag's ``k`` best, by places in their blocks, as products of matrices of bags and terms.

    ``queries``: the bags' terms, how many each has, and what each scores itself; ``candidates``: terms, how many, weights.
    """
    import numpy as np

    (q_codes, q_sizes, own), (c_codes, c_sizes, c_w) = queries, candidates
    asked, weights = np.zeros((len(q_sizes), n_terms)), np.zeros((n_terms, len(c_sizes)))
    asked[np.repeat(np.arange(len(q_sizes)), q_sizes), q_codes] = 1.0
    weights[c_codes, np.repeat(np.arange(len(c_sizes)), c_sizes)] = c_w
    out, width = [], min(k, len(c_sizes))
    for at in range(0, len(asked), MATRIX_ROWS):
        total = asked[at : at + MATRIX_ROWS] @ weights
        self_score = own[at : at + MATRIX_ROWS]
        floor = np.partition(total, len(c_sizes) - width, axis=1)[:, len(c_sizes) - width] - self_score * 10.0**-PLACES
        i, j = np.nonzero((total > 0) & (total >= floor[:, None]))
        share = np.divide(total[i, j], self_score[i], out=np.zeros(len(i)), where=self_score[i] > 0)
        score = np.rint(np.minimum(share, 1.0) * 10.0**PLACES) / 10.0**PLACES
        order = np.lexsort((j, -score, i))
        i, j, score = i[order], j[order], score[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        best = nth < k
        out.append((at + i[best], j[best], score[best]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _compare(k: int):
    """A function that yields, of two blocks of bags, each query bag's ``k`` best candidate bags: by rounded score, then by id."""

    def compare(q: pa.Table, c: pa.Table) -> pa.Table:
        import numpy as np

        c = c.sort_by("id")  # places in the block are in order of the ids
        q_bags, c_bags = (pa.concat_arrays(t["value"].chunks) for t in (q, c))
        q_terms, c_terms, c_w = q_bags.field("terms"), c_bags.field("terms"), c_bags.field("w").flatten().to_numpy()
        codes = pa.concat_arrays([c_terms.flatten(), q_terms.flatten()]).dictionary_encode()
        n_terms, codes = len(codes.dictionary), codes.indices.to_numpy()
        c_codes, q_codes = codes[: len(c_w)], codes[len(c_w) :]
        if n_terms * (len(q) + len(c)) <= MATRIX_CELLS:
            i, j, score = _products(k, (q_codes, q_terms.value_lengths().to_numpy(), q_bags.field("own").to_numpy()), (c_codes, c_terms.value_lengths().to_numpy(), c_w), n_terms)
            return pa.table({"query_id": q["id"].to_numpy()[i], "cand_id": c["id"].to_numpy()[j], "score": score})
        order = np.argsort(c_codes, kind="stable")
        place = np.repeat(np.arange(len(c)), c_terms.value_lengths().to_numpy())[order]
        w, starts = c_w[order], np.concatenate([[0], np.cumsum(np.bincount(c_codes, minlength=n_terms))])
        held = [slice(a, b) for a, b in zip(starts, starts[1:], strict=False)]
        # Terms that most of the block has tell little: they come last, and only to places that can still be among the best.
        common = {}
        for t in np.flatnonzero(np.diff(starts) > len(c) // 2):
            common[t] = np.zeros(len(c))
            common[t][place[held[t]]] = w[held[t]]
        most = {t: x.max() for t, x in common.items()}
        ends, own = np.cumsum(q_terms.value_lengths().to_numpy()), q_bags.field("own").to_numpy()
        out, at, raw = [], 0, np.empty(len(c))
        for i, end in enumerate(ends):
            asked, at, slack = q_codes[at:end], end, own[i] * 10.0**-PLACES
            raw[:] = 0.0
            for t in asked:
                if t not in common:
                    raw[place[held[t]]] += w[held[t]]  # a bag holds a term once
            last = [t for t in asked if t in common]
            rest, found = sum(most[t] for t in last) + slack, np.flatnonzero(raw > 0)
            floor = _nth(raw[found], k) - rest
            if len(found) < k or floor <= 0:
                found, floor = np.arange(len(c)), 0.0
            found = found[raw[found] >= floor]
            total = raw[found]
            for t in last:
                total += common[t][found]
            kept = (total > 0) & (total >= _nth(total, k) - slack)
            found, total = found[kept], total[kept]
            share = total / own[i] if own[i] > 0 else np.zeros(len(found))
            score = np.rint(np.minimum(share, 1.0) * 10.0**PLACES) / 10.0**PLACES
            best = np.lexsort((found, -score))[:k]
            out.append((np.full(len(best), i), found[best], score[best]))
        i, j, score = map(np.concatenate, zip(*out, strict=True))
        return pa.table({"query_id": q["id"].to_numpy()[i], "cand_id": c["id"].to_numpy()[j], "score": score})

    return compare


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """Candidates of ``queries`` (id, title). Scores are 1 for a text like the query itself, never more.

    A document that shares no term is no candidate. Texts of the same terms and weights are one bag, whichever side they are on;
    blocks of bags meet in one task each, which adds up postings and returns the best bags of each query bag.
    Those are then spelled out into documents, of which a bag has ``k`` at most in a list. Bags are kept in memory or on disk, as they are
    counted before they are dealt to blocks. Where the queries are the corpus itself, its bags are the queries' bags.
    """
    same = queries is index.corpus
    query_bags = _bags(index.postings, "w") if same else _bags(_known(index, queries), "own")
    # What is kept keeps its partitions, and many of a few rows each would slow down every later step.
    context = queries.sparkSession.sparkContext
    few = lambda df, n: df.coalesce(max(2 * context.defaultParallelism, -(-n // PART_ROWS)))
    query_bags = few(query_bags, queries.count()).persist()
    held_bags = query_bags
    if not same:
        asked = query_bags.select(F.explode(F.col("bag")["term"]).alias("term")).distinct()
        held_bags = _bags(index.postings.join(asked, "term", "left_semi"), "w")
    query_sets = few(query_bags.groupBy("bag").agg(F.min("id").alias("id")), query_bags.count()).persist()
    own = F.aggregate("bag", F.lit(0.0), lambda total, x: total + x["w"])
    left = query_sets.select("id", F.struct(F.col("bag")["term"].alias("terms"), own.alias("own")).alias("value"))
    first = Window.partitionBy("bag").orderBy("id")
    members = held_bags.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k)
    members = members.groupBy("bag").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    right = few(members, (query_bags if same or index.corpus is None else index.corpus).count()).select(
        F.get("ids", F.lit(0)).alias("id"), "ids", F.struct(F.col("bag")["term"].alias("terms"), F.col("bag")["w"].alias("w")).alias("value")
    ).persist()
    n_left, left_rows = _blocks(left, QUERY_ROWS)
    n_right, right_rows = _blocks(right, BLOCK_ROWS)
    best = block_join(left, right, _compare(k), "query_id long, cand_id long, score double", left_rows, right_rows, n_left, n_right)
    best = top_k(best, k).join(right.select(F.col("id").alias("cand_id"), "ids"), "cand_id")
    # Documents of better bags come first; a bag need not give more than is left behind them.
    upto, level = Window.partitionBy("query_id").orderBy(F.col("score").desc()), Window.partitionBy("query_id", "score")
    before = (F.sum(F.size("ids")).over(upto) - F.sum(F.size("ids")).over(level)).cast("int")
    best = best.withColumn("before", before).where(F.col("before") < k)
    found = top_k(best.select("query_id", "score", F.explode(F.slice("ids", F.lit(1), F.lit(k) - F.col("before"))).alias("cand_id")), k)
    lists = found.groupBy(F.col("query_id").alias("set")).agg(F.collect_list(F.struct("cand_id", "score", "rank")).alias("list"))
    named = query_bags.join(query_sets.select("bag", F.col("id").alias("set")), "bag").select(F.col("id").alias("query_id"), "set")
    return named.join(lists, "set").select("query_id", F.inline("list"))
