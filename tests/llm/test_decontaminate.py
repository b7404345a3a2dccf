import dataclasses
import random

import numpy as np
import pytest

from likeness.llm import decontaminate as d


def distance(item, text):
    """The least edit distance of item to any stretch of text."""
    row = [0] * (len(text) + 1)
    for n, a in enumerate(item, 1):
        new = [n]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at : at + 1] = ([f"new{rng.randrange(99)}"], [], [words[at], f"new{rng.randrange(99)}"])[rng.randrange(3)]
    return words


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "of", "and"] * 5
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 60)))) for i in range(25)]
    docs = []
    for n in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)[1].split()
            at = rng.randint(0, len(words))
            words[at:at] = edited(rng, item, rng.randint(0, int(0.3 * len(item))))
        docs.append((n, rng.choice([" ", ", "]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return docs, items


def test_finds_what_brute_force_finds(spark):
    docs, items = corpus(1)
    docs += [(900, None), (901, ""), (902, "!!! ??"), (None, items[3][1]), (903, "filler " * 20_000 + items[4][1])]
    rows = items + [(77, None), (78, "too short"), items[0]]
    got = d.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]): r for r in got}
    assert len(found) == len(got)
    true = {}
    for n, text in docs[:-1]:
        for i, item in items:
            t, w = d.tokens(text), d.tokens(item)
            if (k := distance(w, t)) <= int(0.2 * len(w)):
                true[n, i] = k
    true[903, 4] = 0
    assert set(found) <= set(true)  # whatever is reported is verified
    assert len(found) >= 0.99 * len(true) and len(true) > 50
    for key, r in found.items():
        assert r["distance"] >= true[key]
        words = d.tokens(dict(docs)[key[0]])
        stretch = words[r["start_word"] : r["start_word"] + r["n_words"]]
        assert distance(stretch, d.tokens(dict(items)[key[1]])) <= r["distance"]
    assert sum(r["distance"] == true[key] for key, r in found.items()) >= 0.99 * len(found)


def test_blocks_and_cleaning_agree(spark, monkeypatch):
    docs, items = corpus(2)
    docs, items = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(d.matches(docs, items))
    monkeypatch.setattr(d, "BLOCK_BYTES", 1000)
    assert key(d.matches(docs, items)) == whole
    clean = d.clean(docs.withColumn("item_id", docs.doc_id), items)
    assert {r["doc_id"] for r in clean.collect()} == set(range(150)) - {r[0] for r in whole} and clean.columns == ["doc_id", "text", "item_id"]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    assert d.matches(docs, items).count() == d.matches(docs, some).count() == 0
    assert d.clean(some.withColumnRenamed("item_id", "doc_id"), items).count() == 1
    blank = spark.createDataFrame([(1, None), (None, "!?")], "item_id long, text string")
    assert d.matches(some.withColumnRenamed("item_id", "doc_id"), blank).count() == 0


def test_short_items_match_word_for_word(spark):
    items = [(1, "zebra"), (2, "red fox"), (3, "one two three four"), (4, "a b c d e f g")]
    docs = [(1, "The ZEBRA"), (2, "a red, fox"), (3, "a red big fox"), (4, "x one two three four y"), (5, "one two 3 four"), (6, "so a b c d e f g"), (7, "a b c D x f g"), (8, "a b x y e f g"), (9, "zebras")]
    got = d.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["start_word"], r["n_words"], r["distance"]) for r in got.collect()} == {
        (1, 1, 1, 1, 0), (2, 2, 1, 2, 0), (4, 3, 1, 4, 0), (6, 4, 1, 7, 0), (7, 4, 0, 7, 1)}


def test_half_of_the_words_may_differ(spark):
    docs, items = corpus(3)
    docs, items = docs[:40] + [(900, items[2][1])], [i for i in items if len(i[1].split()) < 25][:4] + [items[2]]
    got = d.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), edits=0.5)
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    true = {(n, i) for n, text in docs for i, item in items if distance(d.tokens(item), d.tokens(text)) <= len(d.tokens(item)) // 2}
    assert found <= true and len(found) >= 0.98 * len(true) and (900, items[-1][0]) in found
    with pytest.raises(ValueError):
        d.index([(1, "a b c")], edits=1.0)


def test_candidates_come_from_the_buckets():
    """Windows reach items by equal samples of the embedding alone: without buckets nothing is found, and few others meet."""
    docs, items = corpus(4)
    bench = d.index(items)
    texts = [t for _, t in docs]
    matcher = d.Matcher(bench)
    assert matcher.find(texts)
    symbols, begins, _ = matcher._laid(texts)
    windows = matcher.windows(symbols)
    start, item = matcher.meetings(symbols, windows)
    assert len(start) < 0.1 * sum(len(w) * len(bench.classes[m][1]) for m, w in windows.items()) * len(bench.classes)
    keys = {}
    for walk, moves in enumerate(bench.moves):
        for i, x in enumerate(bench.items):
            own = d.bucket_keys(d.embed(np.append(x, 0), np.zeros(1, np.int64), moves), len(x), walk)[0]
            keys.setdefault(i, set()).update(own.tolist())
    for s, i in list(zip(start.tolist(), item.tolist()))[::50]:
        m = len(bench.items[i])
        own = [d.bucket_keys(d.embed(symbols, np.array([s]), moves), m, walk)[0] for walk, moves in enumerate(bench.moves)]
        assert keys[i] & {k for x in own for k in x.tolist()}
    none = d.Matcher(dataclasses.replace(bench, keys=bench.keys[:0], holds=bench.holds[:0]))
    assert none.find(texts) == {}


def test_edits_meet_as_often_as_planned():
    """Held-out edits, other than those of planning, from the true start alone."""
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(14, 59)))) for i in range(300)]
    matcher = d.Matcher(d.index(items))
    texts, hit = [], 0
    for _, text in items:
        words = text.split()
        texts.append(" ".join(edited(rng, words, int(0.2 * len(words)))))
    found = matcher.find(texts)
    hit = sum((n, i) in found for n, (i, _) in enumerate(items))
    assert hit >= 0.98 * len(items)
