import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.operators import splits, training
from likeness.sources import synthetic


def test_group_split_keeps_groups_together(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 150).alias("label"))
    a, b = (sorted(map(tuple, splits.group_split(rows, seed=7).collect())) for _ in range(2))
    assert a == b and len(a) == 1000
    groups = {}
    for i, s in a:
        groups.setdefault(i % 150, set()).add(s)
    assert all(len(s) == 1 for s in groups.values())
    sizes = [sum(s == {name} for s in groups.values()) for name in splits.SPLITS]
    assert sizes == [105, 15, 30]
    counts = {r["split"]: r["groups"] for r in splits.split_counts(rows, splits.group_split(rows, seed=7)).collect()}
    assert counts == dict(zip(splits.SPLITS, sizes))
    with pytest.raises(ValueError, match="add up"):
        splits.group_split(rows, (0.5, 0.1, 0.1))


def test_with_split_checks_its_inputs(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string")
    split = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "id long, split string")
    assert [r["id"] for r in splits.with_split(rows, split, "val").collect()] == [2]
    for bad in (lambda: splits.with_split(rows, split, "dev"), lambda: splits.with_split(rows, split.where("id = 1"), "val"),
                lambda: splits.with_split(rows.unionByName(rows), split, "val"), lambda: splits.with_split(rows, split.unionByName(split), "val")):
        with pytest.raises(ValueError):
            bad()


def test_logreg_minimises_the_penalised_loss(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = (rng.random(600) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5] + 0.3)))).astype(float)
    rows = spark.createDataFrame([(*map(float, r), bool(t)) for r, t in zip(x, y)], "a double, b double, c double, same boolean")
    model = training.fit_logreg(rows, ["a", "b", "c"], l2=0.5)
    design, w, pull = np.column_stack([x, np.ones(600)]), np.zeros(4), np.array([1.0, 1.0, 1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(pull), design.T @ (p - y) + pull * w)
    assert [*model["coef"], model["intercept"]] == pytest.approx(w.tolist(), abs=1e-4)
    assert (model["n_pairs"], model["n_positive"]) == (600, int(y.sum()))


def test_mining_export_and_triplets(spark):
    rng = random.Random(3)
    labels = {i: i % 7 for i in range(60)}
    rows = [(q, c, round(1 - n / 40, 3), n + 1) for q in labels for n, c in enumerate([q, *rng.sample([c for c in labels if c != q], 30)])]
    found = spark.createDataFrame(rows, "query_id long, cand_id long, score double, rank int")
    own = spark.createDataFrame(list(labels.items()), "id long, label long")
    negatives = training.hard_negatives(found, own, 20, 5)
    expected = []
    for q in labels:
        wrong = [c for a, c, _, n in rows if a == q and 2 <= n <= 21 and labels[c] != labels[q]][:5]
        expected += [(q, c, n) for n, c in enumerate(wrong, 1)]
    assert sorted(map(tuple, negatives.collect())) == sorted(expected)
    folds = splits.fold_assign(own)
    pairs = training.export_pairs(found, own, 20, folds).collect()
    assert len(pairs) == 1200 and all(r["same"] == (labels[r["query_id"]] == labels[r["cand_id"]]) for r in pairs)
    assert len({(labels[r["query_id"]], r["fold"]) for r in pairs}) == 7
    trios = training.triplets(own, negatives.where("query_id < 30")).collect()
    assert {r["anchor"] for r in trios} == set(labels)
    assert all(labels[r["anchor"]] == labels[r["positive"]] != labels[r["negative"]] and r["anchor"] != r["positive"] for r in trios)


def test_judge_pairs_must_be_unique(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5, True), (1, 3, 0.4, False)], "query_id long, cand_id long, base_score double, same boolean")
    scores = spark.createDataFrame([(1, 2, 3.0), (9, 9, 1.0)], "query_id long, cand_id long, score double")
    assert [r["pair_score"] for r in training.judge_pairs(pairs, scores).collect()] == [3.0]
    with pytest.raises(ValueError):
        training.judge_pairs(pairs, scores.unionByName(scores))


def test_title_vectors_and_jaccard(spark):
    titles = spark.createDataFrame([(1, "red ball"), (2, "red red"), (3, "unknown"), (4, None)], "id long, title string")
    words = spark.createDataFrame([("red", [2.0, 0.0]), ("ball", [0.0, 5.0])], "term string, vector array<double>")
    idf = spark.createDataFrame([("red", 1.0)], "term string, idf double")
    got = {r["id"]: r["embedding"] for r in training.title_vectors(titles, words, idf).collect()}
    assert got[1] == pytest.approx([2**-0.5, 2**-0.5]) and got[2] == pytest.approx([1.0, 0.0]) and got[3] == got[4] == [0.0, 0.0]
    rng = random.Random(4)
    texts = {i: " ".join(rng.choices("abcdefghij", k=rng.randint(1, 8))) for i in range(80)}
    pairs = {(r["a"], r["b"]) for r in training.jaccard_pairs(spark.createDataFrame(list(texts.items()), "id long, title string"), 0.6).collect()}
    sets = {i: set(t.split()) for i, t in texts.items()}
    assert pairs == {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6}


def test_jaccard_compares_a_set_once(spark, monkeypatch):
    rng = random.Random(5)
    kinds = [" ".join(rng.sample("abcdefghijkl", rng.randint(1, 12))) for _ in range(30)] + [None, "", "a b c d", "d c b a", "a b c d e"]
    titles = {i: rng.choice(kinds) for i in range(250)}
    rows = spark.createDataFrame(list(titles.items()), "id long, title string")
    compared, compare = [], training._similar_classes
    monkeypatch.setattr(training, "_similar_classes", lambda sets, *rest: compared.append(sets.count()) or compare(sets, *rest))
    sets = {i: set((t or "").split()) for i, t in titles.items()}
    likeness = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j and sets[i] | sets[j]}
    for least in (0.3, 0.8, 1.0):
        got = sorted((r["a"], r["b"], r["jaccard"]) for r in training.jaccard_pairs(rows, least).collect())
        assert got == [(*p, j) for p, j in sorted(likeness.items()) if j >= least]
    assert compared == [len({frozenset(x) for x in sets.values() if x})] * 2


def test_catalogue(spark):
    a = synthetic.catalogue(spark, 40, 1).collect()
    assert sorted(a) == sorted(synthetic.catalogue(spark, 40, 1).collect()) and len({r["posting_id"] for r in a}) == len(a)
    groups = {}
    for r in a:
        groups.setdefault(r["label_group"], []).append(r)
    assert all(2 <= len(g) <= 6 for g in groups.values()) and 40 <= len(groups) <= 120
    assert all(len(r["image_phash"]) == 16 and r["title"] for r in a)
    shared = sum(len({r["image_phash"] for r in g}) < len(g) for g in groups.values())
    assert shared > len(groups) * 0.6
