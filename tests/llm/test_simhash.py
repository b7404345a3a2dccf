import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from likeness.llm import components as stars
from likeness.llm import simhash
from likeness.llm.components import connected_components


def plain_fingerprint(text, shingle=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lower.encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_triples_meet_every_four_positions():
    triples = simhash.covering_triples()
    assert len(triples) == 20 and all(any(set(t) <= set(q) for t in triples) for q in combinations(range(8), 4))
    pairs = simhash.spread_pairs(48, 40)
    assert len(set(pairs)) == 40 and all(0 <= a < b < 48 for a, b in pairs)


def test_fingerprints_match_the_plain_definition():
    rng = random.Random(1)
    texts = [None, "", " \n", "one", "a b c", "a b c d", "Ünï A\x1cb C", "same " * 5000] + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 2000))) for _ in range(40)]
    for t in texts:
        assert int.from_bytes(simhash.fingerprint(t), "big") == plain_fingerprint(t), t
        wide = simhash.fingerprint(t, simhash.similarity_scheme(shingle=4))
        assert wide[:8] == simhash.fingerprint(t) and len(wide) == 64


def near_texts(rng, n):
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        words = list(base[i % len(base)])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(99)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("chunk", [2048, 3])
def test_components_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "SHORT", min(chunk, 48))
    texts = near_texts(random.Random(2), 160) + ["", None, "x", "X", "x y"] + ["same text here now again"] * 9
    rows = [(1000 - i, t, "s") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    prints = {i: plain_fingerprint(t) for i, t, _ in rows}
    linked = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    expected = components(prints, linked)
    assert {i: int.from_bytes(r["fp"], "big") for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == expected and len(set(expected.values())) < len(rows) - 20


def jaccard(a, b, k=5):
    x, y = ({tuple(t.split()[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_similar_documents_are_found_and_others_left(spark):
    rng = random.Random(3)
    rows, pairs = [], []
    for i in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(80, 400))]
        other = list(words)
        for _ in range(rng.randint(0, len(words) // 25)):
            other[rng.randrange(len(words))] = f"e{rng.randrange(999)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        pairs.append(jaccard(rows[-1][1], rows[-2][1]))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [got[2 * i + 1] == 2 * i for i in range(150)]
    assert all(g in (i, i - i % 2) for i, g in got.items())  # nothing across pairs
    assert np.mean([f for f, j in zip(found, pairs) if j >= 0.8]) >= 0.95
    assert not any(f for f, j in zip(found, pairs) if j < 0.6)
    kept = simhash.keep_one(spark.createDataFrame([*rows, (0, rows[0][1]), (None, "a"), (None, "a")], "doc_id long, text string"))
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, g in got.items() if i == g) and ids.count(None) == 2


def test_a_line_that_two_texts_repeat_does_not_make_them_similar(spark):
    rng = random.Random(5)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for i in range(12):
        line = own(10 + i)
        rows += [(2 * i + j, " ".join([own(104), *[line] * 20])) for j in (0, 1)]
    assert max(jaccard(rows[i][1], rows[i + 1][1]) for i in range(0, len(rows), 2)) < 0.2
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _ in rows]


@pytest.mark.parametrize("crowd", [0, 16])
def test_links_are_those_of_the_exact_similarity(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(6)
    texts = []
    for i in range(120):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 9, 30, 100, 250]))]
        texts.append(words)
        for _ in range(rng.choice([1, 1, 3])):
            texts.append(list(words))
            for _ in range(rng.randint(len(words) // 60, max(1, len(words) // 25))):
                texts[-1][rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    texts += [["a"], ["A"], ["b"], []]
    texts = [" ".join(t) for t in texts]
    exact = {(a, b): jaccard(texts[a].lower(), texts[b].lower()) for a, b in combinations(range(len(texts)), 2) if b - a < 4}
    assert sum(0.7 <= j < 0.8 for j in exact.values()) > 30 and sum(0.8 <= j < 0.85 for j in exact.values()) > 20
    got = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components(range(len(texts)), [p for p, j in exact.items() if j >= 0.8])


def test_components_of_odd_graphs(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(500, 500)] + [(100, i) for i in range(101, 180)] + [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(40)] + [(-5, 7), (-5, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: r for i, r in components(nodes, [e for e in edges if e[0] != e[1]]).items()}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_null_ids_and_empty_table(spark):
    rows = [(None, "a b c"), (3, "a b c"), (None, "other words entirely different"), (3, "a b c")]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (0, 3), (3, 3), (3, 3)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_keys_are_joined_like_others(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 7 if i % 3 else None, i) for i in range(200)] + [(50, i) for i in range(400)], "key long, i long")
    groups = rows.groupBy("key").agg(F.min("i").alias("m"), F.count("*").alias("n"))
    plain = sorted(map(tuple, rows.join(groups.drop("n"), "key").collect()))
    for small, hot in ((0, 5), (0, 25), (0, 10_000), (600, 5)):
        monkeypatch.setattr(stars, "SMALL_ROWS", small)
        monkeypatch.setattr(stars, "HOT_ROWS", hot)
        assert sorted(map(tuple, stars.hot_join(rows, groups, "key", 600).collect())) == plain


def test_thinned_pairs_join_the_same(spark):
    rng = random.Random(7)
    edges = [(min(x), max(x)) for x in ((rng.choice([0, 3, 5, 8, 13, 21]), rng.randrange(300)) for _ in range(4000)) if x[0] != x[1]]
    edges += [(500 + i, 501 + i) for i in range(40)] + [(700, 700), (901, 900), (900, 901)]
    got = [tuple(r) for r in simhash._thinned(spark.createDataFrame(edges, "a long, b long")).collect()]
    nodes = {x for e in edges for x in e}
    assert components(nodes, got) == components(nodes, edges) and all(a < b for a, b in got)
    assert len(got) == len(set(got)) <= 2 * len(nodes) + 6 * 6 < len(set(edges))


def test_a_kept_id_leaves_its_row_and_texts_stay_where_they_are(spark):
    a, b = ("the first text of seven words here", "another text that is unlike the first")
    rows = spark.createDataFrame([(3, a, 1), (1, b, 2), (3, b, 3), (3, a, 1), (None, b, 4), (7, None, 5), (6, "", 6)], "`doc_id` long, text string, `_at` int").repartition(3)
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns and kept.dtypes == rows.dtypes
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(3, a, 1), (1, b, 2), (None, b, 4), (6, "", 6)], key=str)
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    assert simhash.keep_one(rows.limit(0)).count() == 0


SIMILAR = simhash.similarity_scheme(distinct=True)


def test_a_crowd_of_near_copies_is_proposed_few_times(spark):
    rng = random.Random(8)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, simhash.fingerprint(" ".join(words), SIMILAR)))
    rows += [(1000 + i, simhash.fingerprint(" ".join(f"x{rng.randrange(10**6)}" for _ in range(100)), SIMILAR)) for i in range(50)]
    fps, keys = dict(rows), lambda fp: {(n, *(fp[p] for p in places)) for n, places in enumerate(SIMILAR.keys)}
    kinds = {n: keys(fp) for n, fp in rows}
    near = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(fps[a][:16], fps[b][:16], strict=True)) <= SIMILAR.max_bits
    met = {(a, b) for a, b in combinations(fps, 2) if kinds[a] & kinds[b] and near(a, b)}
    nodes = spark.createDataFrame([(n, bytearray(fp)) for n, fp in rows], "node long, fp binary")
    got = [(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in simhash.links(nodes, SIMILAR).collect()]
    assert components(fps, got) == components(fps, met) and set(got) <= met
    assert len(got) <= 5 * 400 < len(met) / 10
    # Between groups all pairs are wanted, and each comes from one list of those that the carried words tell.
    more = nodes.select("node", "fp", F.col("node").alias("root"), F.lit(146).alias("size"), F.lit(146).alias("others"), F.lit(bytes(simhash.MARKED // 8)).alias("marks"))
    pairs = [(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in simhash.links(more, SIMILAR, 0.8).collect()]
    assert set(pairs) == met and len(pairs) <= 3 * len(met)
