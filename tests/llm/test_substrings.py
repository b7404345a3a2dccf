import hashlib
import random

import numpy as np

from likeness.llm import substrings


def brute(rows, window):
    """rows: distinct (doc_id, text) -> (n_words, n_removed, sha256)."""
    words = {i: (t or "").encode().split() for i, t in rows}
    seen, out = set(), {}
    for i in sorted(words, key=lambda i: (i is None, i)):
        w, gone = words[i], set()
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            if key in seen:
                gone.update(range(a, a + window))
            seen.add(key)
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def run(spark, rows, **kind):
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, did string")
    return df, {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in substrings.remove_repeats(df, **kind).collect()}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 6)):
            part = rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
            cut = rng.randint(0, len(part))
            w += part[cut:] if rng.random() < 0.3 else part
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    return rows


def test_matches_brute_force(spark):
    rows = corpus(1)
    rows += [(500, None), (501, ""), (502, " ".join(["ha"] * 3000)), (None, rows[5][1]), (503, rows[6][1]), (-4, rows[7][1]), (504, " ".join(["a b c d e f g"] * 50))]
    _, got = run(spark, rows)
    assert got == brute(rows, 20)


def test_short_windows_match_brute_force(spark):
    rows = corpus(2)
    _, got = run(spark, rows, window=7, gram=3)
    assert got == brute(rows, 7)


def test_blocks_in_parts_match_brute_force(spark, monkeypatch):
    rows = corpus(4) + [(None, "x " * 90), (700, None)]
    monkeypatch.setattr(substrings, "PART_BYTES", 1)
    monkeypatch.setattr(substrings, "MOST_PARTS", 4)
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in substrings.remove_repeats(df).collect()}
    assert got == brute(rows, 20)


def parsed(documents, window):
    """(factors, new windows) of whole documents parsed against each other."""
    words = [t.split() for t in documents]
    segments = np.array([(i, 0, 0, len(w) - window + 1) for i, w in enumerate(words)], substrings._SEGMENT)
    of, found, owner, within, new = substrings._parse(segments, substrings._numbered([w for d in words for w in d]), window)
    return [(int(o), *f) for o, f in zip(of, found.tolist())], {(int(o), int(w)) for o, w, n in zip(owner, within, new) if n}


def test_factors_are_greedy():
    # The second copy of "b c d" occurs first in document 0; a factor opened in document 1 goes on past it.
    found, new = parsed(["b c d", "a b c d e f", "a b c d e g"], 3)
    assert found == [(1, 1, 3, 0, 0), (2, 0, 5, 1, 0)]
    assert new == {(0, 0), (1, 0), (1, 2), (1, 3), (2, 3)}
    found, _ = parsed(["x x x x x x"], 2)
    assert found == [(0, 1, 5, 0, 0)]


def test_words_decide_not_hashes(monkeypatch):
    documents = ["a b c d e", "c d e f g", "b c d e f g a", "a b c d e"]
    expected = parsed(documents, 3)
    monkeypatch.setattr(substrings, "_rolled", lambda values, at, length, base: np.zeros(len(at), np.uint64))
    assert parsed(documents, 3) == expected


def test_only_factors_remove_words(spark, monkeypatch):
    rows = corpus(5, 40)
    spans = {}
    df, got = run(spark, rows)
    for f in substrings.factors(df).collect():
        spans.setdefault(f["doc_id"], set()).update(range(f["start"], f["start"] + f["length"]))
    assert sum(v[1] for v in got.values()) > 0
    for i, text in rows:
        kept = " ".join(w for n, w in enumerate(text.split()) if n not in spans.get(i, ()))
        assert got[i][2] == hashlib.sha256(kept.encode()).hexdigest()


def test_factors_copy_from_the_first_occurrence(spark):
    rows = corpus(3)
    df, _ = run(spark, rows)
    words = {i: (t or "").split() for i, t in rows}
    covered = {i: set() for i in words}
    for f in substrings.factors(df).collect():
        assert f["length"] >= 20 and (f["source_id"], f["source_start"]) < (f["doc_id"], f["start"])
        assert words[f["doc_id"]][f["start"] : f["start"] + f["length"]] == words[f["source_id"]][f["source_start"] : f["source_start"] + f["length"]]
        covered[f["doc_id"]].update(range(f["start"], f["start"] + f["length"]))
    assert {i: len(c) for i, c in covered.items()} == {i: v[1] for i, v in brute(rows, 20).items()}


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"x{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in substrings.report(df).collect()) == [(1, 0), (1, 0), (2, 40)]
    assert substrings.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
