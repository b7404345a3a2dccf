import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from likeness.llm import mixing


def targets(sizes):
    """Sources with their sizes, in order -> targets."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + n % 3 for n, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and left * weight[s] / share > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else left * weight[s] / share for s in order}
        full |= over


def corpus(rng, n):
    rows = []
    for i in range(n):
        source = rng.choices(["a", "b", "Z", "é", None, "tiny"], [30, 8, 5, 4, 3, 1])[0]
        rows.append((i, " \t".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 60))), source, 0))
    return rows


def test_taken_words_follow_the_queue(spark):
    rows = corpus(random.Random(1), 400) + [(900, None, "a", 0), (901, " \n", None, 0), (None, "x y", "b", 0), (5, "again here", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.taken_words(df).collect()
    assert len(got) == len(rows) and Counter(got) == Counter(mixing.taken_words(df.repartition(7)).collect())
    size = lambda t: len((t or "").encode().split())
    sums = Counter()
    for _, t, s, _ in rows:
        sums[s] += size(t)
    goal = targets(sums)
    per = {}
    for i, t, s, _ in rows:
        turn = hashlib.md5(f"42|{'' if i is None else i}".encode()).hexdigest()
        per.setdefault(s, []).append((turn, size(t), i))
    queued = []
    for s, queue in per.items():
        start = 0
        for at, (_, n, i) in enumerate(sorted(queue, key=lambda x: x[:2])):
            for e in range(3):
                if n and start + e * sums[s] < goal[s]:
                    queued.append(((start + e * sums[s] + n) / goal[s], s is not None, s or "", start, e, (s, at)))
            start += n
    left, taken = sum(sums.values()), Counter()
    for *_, (s, at) in sorted(queued):
        n = sorted(per[s], key=lambda x: x[:2])[at][1]
        taken[s, at] += min(n, left)
        left -= min(n, left)
    expected = Counter((i, n, taken[s, at]) for s, queue in per.items() for at, (_, n, i) in enumerate(sorted(queue, key=lambda x: x[:2])))
    assert left == 0 and all(t <= 3 * n for _, n, t in expected)
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == expected
    for s, queue in per.items():
        assert abs(sum(taken[s, at] for at in range(len(queue))) - goal[s]) <= max(n for _, n, _ in queue)
    by_target = {round(r["target"], 6) for r in got}
    assert by_target == {round(x, 6) for s, x in goal.items()}


def test_mix_holds_what_was_taken(spark):
    rows = corpus(random.Random(2), 150) + [(3, "same id", "b", 7), (3, "same id", "b", 7), (None, "no id", "b", 5), (None, None, None, 0)]
    clashing = ["_key", "_row", "_doc", "_finish", "_item", "_own", "served", "size", "a.b"]
    df = spark.createDataFrame([(*r[:3], len(r[1] or ""), *[f"{r[0]}{c}" for c in clashing]) for r in rows], ["doc_id", "text", "source", "n_chars", *clashing])
    out = mixing.mix(df)
    assert out.columns == df.columns and all(r[c] == f"{r['doc_id']}{c}" for r in out.collect() for c in clashing)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    found = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum(words).alias("n")).collect()}
    taken = {r["doc_id"]: r["n"] for r in mixing.taken_words(df).groupBy("doc_id").agg(F.sum("taken").alias("n")).where("n > 0").collect()}
    assert found == taken
    texts = {(r[0], r[1]) for r in rows}
    whole = [r for r in out.collect() if (r["doc_id"], r["text"]) in texts]
    assert out.count() - len(whole) <= 1 and sum(found.values()) == sum(len((r[1] or "").split()) for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_targets_reshare_the_excess(spark):
    stats = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1000), ("d", 10), (None, 5)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(stats).collect()}
    assert got == pytest.approx(targets({"a": 1, "b": 2, "c": 1000, "d": 10, None: 5})) and sum(got.values()) == pytest.approx(1018)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken_words(df).count() == mixing.mix(df).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["taken"]) for r in mixing.taken_words(blank).collect()) == [(1, 0), (2, 0)] and mixing.mix(blank).count() == 0


def test_the_mix_is_the_sorted_queue_cut_at_the_budget(spark, monkeypatch):
    rows = corpus(random.Random(3), 200)
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    items, _ = mixing.schedule(df)
    served = sorted((r["finish_time"], r["served"], r["size"]) for r in items.collect())
    assert sum(s for _, s, _ in served) == sum(len(r[1].split()) for r in rows)
    assert sum(s < n for _, s, n in served) <= 1 and served[-1][0] >= 1
    before = Counter(mixing.taken_words(df).collect())
    # Without the queue's order, the query's words are others.
    monkeypatch.setattr(mixing, "_running", lambda rows, by, *_, run=mixing._running: run(rows, by, *_) if by else rows.withColumn("_before", F.lit(0)))
    assert Counter(mixing.taken_words(df).collect()) != before
