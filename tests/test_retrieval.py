import duckdb
import numpy as np
import pytest
from oracle import differences
from pyspark.sql import functions as F

from likeness import oracles, queries
from likeness.functions.vectors import hamming, hex_to_long, l2_normalise, safe_divide, sign_hash
from likeness.operators import bm25, dense, fusion, hashes
from likeness.operators.candidates import drop_self, top_k

TITLES = ["Samsung Galaxy A52 128GB hitam", "Samsung Galaxy A52 64GB hitam", "Xiaomi Redmi Note 10 128GB", "Wardah lip cream 30ml"]


def frame(spark, titles):
    return spark.createDataFrame(list(enumerate(titles)), "id long, title string")


def listed(found):
    return [(r["query_id"], r["cand_id"], r["score"], r["rank"]) for r in found.orderBy("query_id", "rank").collect()]


def cands(spark, rows):
    return spark.createDataFrame(rows, "query_id long, cand_id long, score double, rank int")


def test_bm25_ranks_by_shared_terms_and_scores_itself_one(spark):
    index = bm25.build(frame(spark, [*TITLES, None, ""]))
    got = listed(bm25.search(index, spark.createDataFrame([(9, "galaxy a52 128 gb")], "id long, title string"), 4))
    assert [c for _, c, _, _ in got[:2]] == [0, 1] and 3 not in [c for _, c, _, _ in got]
    own = listed(bm25.search(index, frame(spark, TITLES), 1))
    assert [(q, c) for q, c, _, _ in own] == [(i, i) for i in range(4)] and all(s == pytest.approx(1.0) for _, _, s, _ in own)
    assert index.constants.first()["n"] == 6
    assert bm25.search(bm25.build(frame(spark, [])) if False else index, frame(spark, ["unknown words"]), 3).count() == 0


def test_bm25_meets_equal_titles_once_and_agrees_with_sql(spark, monkeypatch):
    words = ["merah", "biru", "tua", "muda", "kaos", "polos", "30ml", "50ml"]
    rng = np.random.default_rng(3)
    some = [" ".join(["toko", *rng.choice(words, 4)]) for _ in range(60)]
    corpus = frame(spark, [some[i] for i in rng.integers(0, 60, 900)] + ["lain", None])
    asked = frame(spark, [*some, *some, "toko", "merah merah asing", "asing", "lain toko"])
    con = duckdb.connect()
    for name, df in (("t", corpus), ("u", asked)):
        con.register(name, df.toPandas())
    sql = oracles._with(oracles._bm25("SELECT * FROM t", "SELECT * FROM u"), oracles._topk("SELECT * FROM b_scored", 20))
    met, join = [], bm25.block_join
    monkeypatch.setattr(bm25, "block_join", lambda q, c, *rest: met.append((q.count(), c.count())) or join(q, c, *rest))
    for rows in (16384, 9):
        monkeypatch.setattr(bm25, "BLOCK_ROWS", rows)
        monkeypatch.setattr(bm25, "QUERY_ROWS", rows)
        assert differences(bm25.search(bm25.build(corpus), asked, 20), con, sql) == ""
    assert all(q <= 63 and c <= 61 for q, c in met) and len(met) == 2


@pytest.mark.parametrize("cells", [8_000_000, 0])
def test_bm25_of_a_corpus_against_itself_weighs_it_once(spark, monkeypatch, cells):
    monkeypatch.setattr(bm25, "MATRIX_CELLS", cells)
    monkeypatch.setattr(bm25, "_known", lambda *_: pytest.fail("the corpus's own bags are known"))
    words = ["merah", "biru", "tua", "muda", "kaos", "polos", "30ml", "50ml"]
    rng = np.random.default_rng(4)
    rows = frame(spark, [" ".join(rng.choice(words, rng.integers(1, 6))) for _ in range(300)] + ["lain", None, ""])
    con = duckdb.connect()
    con.register("t", rows.toPandas())
    sql = oracles._with(oracles._bm25("SELECT * FROM t", "SELECT * FROM t"), oracles._topk("SELECT * FROM b_scored", 20))
    for block in (16384, 50):
        monkeypatch.setattr(bm25, "BLOCK_ROWS", block)
        monkeypatch.setattr(bm25, "QUERY_ROWS", block)
        assert differences(bm25.search(bm25.build(rows), rows, 20), con, sql) == ""


def test_one_table_votes_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.normal(size=(40, 8)))], "id long, embedding array<double>")
    same = spark.createDataFrame(rows.collect(), rows.schema)
    votes, vote = [], dense.vote
    monkeypatch.setattr(dense, "vote", lambda *a: votes.append(a) or vote(*a))
    assert listed(dense.search(rows, rows, 5, 3)) == listed(dense.search(rows, same, 5, 3)) and len(votes) == 3


def test_drop_self_removes_only_the_query(spark):
    rows = [(0, 0, 1.0, 1), (0, 2, 0.5, 2), (0, 1, 0.4, 3), (1, 0, 0.7, 1), (1, 1, 1.0, 2), (1, 2, 0.2, 3)]
    assert [(q, c) for q, c, _, _ in listed(drop_self(cands(spark, rows), 2))] == [(0, 2), (0, 1), (1, 0), (1, 2)]


def test_top_k_breaks_ties_by_candidate(spark):
    rows = spark.createDataFrame([(1, 5, 0.1 + 0.2), (1, 3, 0.3), (1, 4, 0.9)], "query_id long, cand_id long, score double")
    assert [c for _, c, _, _ in listed(top_k(rows, 3))] == [4, 3, 5]


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, embedding array<float>")


def test_dense_uses_cosine_and_demands_vectors(spark):
    corpus = vectors(spark, [(1, [1, 0]), (2, [0.8, 0.6]), (3, [0, 1])])
    got = listed(dense.search(corpus.where("id = 1"), corpus, 3))
    assert [c for _, c, _, _ in got] == [1, 2, 3] and [s for _, _, s, _ in got] == pytest.approx([1.0, 0.8, 0.0], abs=1e-6)
    with pytest.raises(KeyError, match="no vector for 1 rows"):
        dense.look_up(spark.createDataFrame([(1,), (77,)], "id long"), corpus)
    with pytest.raises(ValueError, match="no vector store"):
        dense.store({"type": "nothing"})


def test_stores_agree_with_brute_force(spark, monkeypatch):
    from likeness.operators import blocks

    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    corpus = vectors(spark, list(enumerate(v.tolist())))
    queries = corpus.where("id < 20")
    best = np.argsort(-(v[:20].astype(float) @ v.T.astype(float)), axis=1)[:, :5]
    for rows in (4096, 7):
        monkeypatch.setattr(blocks.block_join, "__defaults__", (rows, rows * 3))
        got = listed(dense.store({"type": "faiss", "index": "flat"})(queries, corpus, 5))
        assert [c for _, c, _, _ in got] == best.ravel().tolist()
    monkeypatch.undo()
    rough = {(q, c) for q, c, _, _ in listed(dense.store({"type": "faiss", "index": "hnsw"})(queries, corpus, 5))}
    assert len(rough & {(q, int(c)) for q in range(20) for c in best[q]}) >= 90
    odd = corpus.unionByName(spark.createDataFrame([(900, None), (901, [0.0] * 16)], "id long, embedding array<float>"))
    assert {q for q, *_ in listed(dense.approximate(odd, odd, 3))} == {*range(300), 901}
    assert dense.approximate(corpus.limit(0), corpus, 3).count() == dense.approximate(corpus, corpus.limit(0), 3).count() == 0
    assert len(listed(dense.exact(queries, corpus.where("id < 3"), 5))) == 60


def test_votes_are_weighted_means_of_neighbours(spark):
    v = {0: np.array([1.0, 0, 0]), 1: np.array([0.8, 0.6, 0]), 2: np.array([0, 0, 1.0]), 3: np.array([-1.0, 0, 0])}
    corpus = vectors(spark, list(v.items()))
    got = {r["id"]: r["embedding"] for r in dense.vote(corpus, corpus, 2, 3.0).collect()}
    expected = 1.0 * v[0] + 0.8**3 * v[1]
    assert got[0] == pytest.approx(expected / np.linalg.norm(expected), abs=1e-6)
    assert got[3] == pytest.approx([-1, 0, 0])


def test_hashes(spark):
    df = spark.createDataFrame([("ffffffffffffffff", "7fffffffffffffff"), ("ffff0000ffff0000", "0000ffff0000ffff"), ("0", "3")], "a string, b string")
    got = [r[0] for r in df.select(hamming(hex_to_long(F.col("a")), hex_to_long(F.col("b")))).collect()]
    assert got == [1, 64, 2]
    signs = spark.createDataFrame([([1.0] * 64,), ([-1.0] * 63 + [2.0],), ([0.0] * 64,)], "v array<float>").select(sign_hash(F.col("v")))
    assert [r[0] for r in signs.collect()] == [-1, -(2**63), 0]


@pytest.mark.parametrize("radius", [0, 3, 6, 7, 12, 18])
def test_hamming_join_finds_every_pair(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(-(2**63), 2**63, size=20, dtype=np.int64)
    values = []
    for i in range(150):
        v = int(base[i % 20]) % 2**64
        for _ in range(rng.integers(0, 12)):
            v ^= 1 << int(rng.integers(0, 64))
        values.append(v - 2**64 if v >= 2**63 else v)
    df = spark.createDataFrame([*enumerate(values), (999, None)], "id long, hash long")
    got = sorted((r["query_id"], r["cand_id"], r["dist"]) for r in hashes.hamming_join(df.where("id < 40"), df, radius).collect())
    dist = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert got == [(i, j, dist(values[i], values[j])) for i in range(40) for j in range(150) if dist(values[i], values[j]) <= radius]
    assert sum(w for _, w in hashes.bands(radius)) == 64


def test_boost_puts_hash_hits_first(spark):
    titles = frame(spark, ["kaos polos hitam", "baju anak", "sepatu lari"])
    h = spark.createDataFrame(list(enumerate(["ffff0000ffff0000", "ffff0000ffff0001", "0000ffff0000ffff"])), "id long, x string").select("id", hex_to_long(F.col("x")).alias("hash"))
    found = drop_self(hashes.boost(bm25.search(bm25.build(titles), titles, 3), hashes.hamming_join(h, h, 2), 3), 2)
    assert [(c, s) for q, c, s, _ in listed(found) if q == 0] == [(1, 1.0)]


def test_boost_order(spark):
    base = cands(spark, [(1, 7, 1.0, 1), (1, 9, 0.8, 2), (1, 8, 0.5, 3)])
    hits = spark.createDataFrame([(1, 3), (1, 8)], "query_id long, cand_id long")
    assert [(c, s) for _, c, s, _ in listed(hashes.boost(base, hits, 4))] == [(7, 1.0), (8, 1.0), (3, 1.0), (9, 0.8)]


def test_rrf_rewards_agreement(spark):
    titles = frame(spark, ["kaos polos hitam", "kaos polos putih", "sepatu lari hitam"])
    members = [bm25.search(bm25.build(titles, k1), titles, 3) for k1 in (1.2, 2.0)]
    got = [r for r in listed(fusion.rrf(members, 3)) if r[0] == 0]
    assert got[0][1] == 0 and got[0][2] == pytest.approx(1.0) and [r[2] for r in got] == sorted((r[2] for r in got), reverse=True)


def test_learned_fusion_matches_the_formula(spark):
    a, b = cands(spark, [(1, 5, 0.9, 1), (1, 6, 0.8, 2)]), cands(spark, [(1, 6, 0.7, 1), (1, 4, 0.1, 2)])
    w, c = [1.0, -0.5, 2.0, 0.25], -1.0
    x = {5: [0.9, 1, 0, 0], 6: [0.8, 0.5, 0.7, 1], 4: [0, 0, 0.1, 0.5]}
    expected = {k: 1 / (1 + np.exp(-(np.dot(v, w) + c))) for k, v in x.items()}
    got = listed(fusion.learned([a, b], 3, w, c))
    assert {c_: s for _, c_, s, _ in got} == pytest.approx(expected, abs=1e-9) and [c_ for _, c_, _, _ in got] == sorted(expected, key=expected.get, reverse=True)
    with pytest.raises(ValueError, match="2 members need 4 weights"):
        fusion.learned([a, b], 3, [1.0, 2.0], 0.0)


def test_rerank(spark):
    base = cands(spark, [(1, 1, 1.0, 1)] + [(1, 10 + i, 0.9 - i / 100, i + 2) for i in range(30)])
    scores = spark.createDataFrame([(1, 10 + i, float(i), i) for i in range(30)] + [(1, 12, -50.0, 99)], "query_id long, cand_id long, score double, at int")
    got = listed(fusion.rerank(base, scores, 50, [1.0, 1.0], 0.0, top_n=5))
    assert [c for _, c, _, _ in got] == [1, 14, 13, 11, 10, 12] and got[0][2] == 1.0
    with pytest.raises(KeyError, match="unscored"):
        fusion.rerank(base, scores.where("cand_id <> 13"), 50, [1.0, 1.0], 0.0, top_n=5)
    left = fusion.rerank(base, scores.where("cand_id <> 13"), 50, [1.0, 1.0], 0.0, top_n=20)
    assert 13 not in [c for _, c, _, _ in listed(left)]


def test_small_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], 1.0, 0.0), ([0.0, 0.0], 1.0, 2.0)], "v array<float>, a double, b double")
    got = df.select(l2_normalise(F.col("v")), safe_divide(F.col("a"), F.col("b"))).collect()
    assert [list(r) for r in got] == [[[0.6, 0.8], 0.0], [[0.0, 0.0], 0.5]]


def test_titles_without_a_vector_are_searched_too(spark, data, tmp_path):
    spark.read.parquet(f"{data}/part.parquet").where("p_partkey < 60").write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{data}/embeddings.parquet").where("vec_id <= 20").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    sql = oracles._with([*oracles._bm25(oracles.TITLES, oracles.TITLES), oracles._B_TOP], "SELECT * FROM b_top")
    got = queries.bm25_topk_titles(spark, str(tmp_path))
    assert got.select("query_id").distinct().count() == 60 and differences(got, con, sql) == ""
    assert queries.phash_boost_titles(spark, str(tmp_path)).select("query_id").distinct().count() == 60


def test_kept_bags_have_no_more_partitions_than_their_rows_need(spark):
    rows = spark.createDataFrame([(i, f"red mug {i % 7} ml") for i in range(40)], "id long, title string")
    held = lambda: dict(spark.sparkContext._jsc.getPersistentRDDs())
    before, partitions = set(held()), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = bm25.search(bm25.build(rows), rows, 5).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    kept = [rdd.getNumPartitions() for n, rdd in held().items() if n not in before]
    assert len(found) == 200 and kept and max(kept) <= 2 * spark.sparkContext.defaultParallelism
