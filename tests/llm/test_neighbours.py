import math
from functools import reduce

import numpy as np

from likeness.llm import neighbours


def brute(rows, k):
    part = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (q, a) in enumerate(part):
        if q is not None and q % 20 == 0:
            others = [(c, b) for n, (c, b) in enumerate(part) if n != at and len(a) == len(b)]
            best = sorted((-reduce(lambda t, p: t + float(p[0]) * float(p[1]), zip(a, b), 0.0), c is None, c) for c, b in others)
            out += [(q, n, c, -s) for n, (s, _, c) in enumerate(best[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted((tuple(r) for r in neighbours.nearest(df, df.vec_id % 20 == 0, k).collect()), key=str)


def test_matches_brute_force_with_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[40][1]) for i in range(30)] + [(20, rows[7][1]), (40, rows[40][1])]
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0, None] * 4), (404, []), (None, [1.0] * 8), (405, [float("inf")] * 8)]
    rows += [(420, [1.0, 2.0]), (421, [2.0, 1.0]), (440, [3.0])]
    assert run(spark, rows) == brute(rows, 5)


def test_rows_that_share_an_id_are_all_candidates(spark):
    found = run(spark, [(1, [0.5, 0.0]), (1, [5.0, 0.0]), (20, [0.5, 0.0]), (20, [1.0, 0.0]), (None, [4.0, 0.0])], 3)
    assert found == sorted([(20, 1, 1, 2.5), (20, 2, None, 2.0), (20, 3, 20, 0.5), (20, 1, 1, 5.0), (20, 2, None, 4.0), (20, 3, 1, 0.5)], key=str)


def test_many_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-2, 3, size=4) * 1.0).tolist()) for i in range(400)]
    monkeypatch.setattr(neighbours, "QUERY_NUMBERS", 40)
    monkeypatch.setattr(neighbours, "CANDIDATE_NUMBERS", 300)
    monkeypatch.setattr(neighbours, "FAN_IN", 2)
    assert run(spark, rows) == brute(rows, 5)


def test_error_bounds_hold():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(50, 64)), rng.normal(size=(60, 64)) * rng.exponential(size=(60, 1))
    (ac, s, ah, ar, _), (bc, t, _, br, bn) = neighbours.quantise(a), neighbours.quantise(b)
    about = neighbours.code_products(ac, bc) * s[:, None] * t[None, :]
    assert (np.abs(about - a @ b.T) <= ah[:, None] * br[None, :] + ar[:, None] * bn[None, :] + 1e-9).all()


def test_empty_table(spark):
    assert run(spark, []) == []
