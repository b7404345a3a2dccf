import math
import random
import zlib

import pytest
import zstandard

from pyspark.sql import functions as F

from likeness.llm import quality


def test_held_out_is_crc32_of_the_id(spark):
    got = {r["doc_id"]: r["h"] for r in spark.range(-5, 200).withColumnRenamed("id", "doc_id").select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(-5, 200)}


def corpus(rng, n):
    good = ["the", "river", "runs", "slowly", "through", "green", "valleys", "and", "old", "towns", "where", "people", "meet"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(good) for _ in range(rng.randint(30, 200))]
        bad = i % 4 == 0
        if bad:
            words = [w.upper() + rng.choice(["!!", "$$$", "***"]) for w in words]
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_separates_held_out_documents(spark):
    docs, labels = corpus(random.Random(1), 240)
    odd = [(900, None, "en"), (901, "", "en"), (902, "x", "en"), (1, docs[1][1], "en"), (None, docs[2][1], "en"), (903, docs[0][1] * 300, "en")]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, quality_score string")
    lab = spark.createDataFrame([*labels, labels[3], (5, None, None), (None, 1, 0), (7777, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, lab)
    rows = quality.score(df, model).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r["quality_score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["quality_score"] for r in rows}
    learned = [q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    assert by[900] == by[901] == pytest.approx(sum(learned) / len(learned))
    assert by[903] < 0.5 and by[None] > 0.5
    assert all((by[i] >= 0.5) == bool(q) for i, q, _ in labels)
    again = quality.fit(df.repartition(5), lab)
    assert again == model


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus(random.Random(2), 120)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    a, b = (quality.fit(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert a == b


def test_one_class_or_none(spark):
    docs, labels = corpus(random.Random(3), 20)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    for own in (labels[1:2], []):
        model = quality.fit(df, spark.createDataFrame(own, "doc_id long, quality int, toxic int"))
        assert {r["quality_score"] for r in quality.score(df, model).collect()} == {0.5}
    assert quality.score(df.limit(0), model).count() == 0


def test_scores_keep_the_share_of_the_labels_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_DOCS", 40)
    rng, docs, labels = random.Random(4), [], []
    for i in range(900):
        good = i % 9 > 0
        words = [rng.choice(("river", "valley", "green", "towns")) + rng.choice("abcdef") for _ in range(30)]
        noise = [rng.choice(("CLICK", "BUY", "WIN")) + rng.choice("ABCDEF") for _ in range(30)]
        part = min(1.0, max(0.0, rng.gauss(0.55 if good else 0.45, 0.12)))  # the classes overlap
        docs.append((i, " ".join(a if rng.random() < part else b for a, b in zip(words, noise))))
        labels.append((i, int(good), 0))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.fit(df, spark.createDataFrame([*labels, *[(10_000 + i, 0, 0) for i in range(900)]], "doc_id long, quality int, toxic int"))
    mean = quality.score(df, model).agg(F.avg("quality_score")).first()[0]
    assert abs(mean - 8 / 9) < 0.06


def test_a_text_too_long_for_the_sample_drops_no_other(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 200_000)
    docs, labels = corpus(random.Random(5), 120)
    first = spark.createDataFrame([(i,) for i, q, _ in labels if q == 0 and zlib.crc32(str(i).encode()) % 3 != 1], "doc_id long").orderBy(F.xxhash64("doc_id")).first()[0]
    docs[first] = (first, docs[first][1] * 400, "en")
    df, lab = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    by = {r["doc_id"]: r["quality_score"] for r in quality.score(df, quality.fit(df, lab)).collect()}
    assert all((by[i] >= 0.5) == bool(q) for i, q, _ in labels)


def test_held_out_accuracy_on_the_tables(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where(quality.held_out(F.col("doc_id")))
    right = scored.agg(F.avg(((F.col("quality_score") >= 0.5) == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right >= 0.95


def test_scores_are_what_the_definition_says(spark):
    """Recomputed block by block with the dictionaries as they are."""
    docs, labels = corpus(random.Random(5), 90)
    df = spark.createDataFrame([*docs, (800, None, "en"), (801, docs[1][1] * 40, "en")], "doc_id long, text string, quality_score string")
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kind = zstandard.DICT_TYPE_RAWCONTENT if model.raw else zstandard.DICT_TYPE_FULLDICT

    def size(block, book):
        squeezed = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(book, dict_type=kind), write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(squeezed.compress(block))

    rows = quality.score(df, model).collect()
    for r in rows:
        data = (r["text"] or "").encode()
        blocks = [data[at : at + 512] for at in range(0, len(data), 512)]
        saved = sum(size(b, model.bad) - size(b, model.good) for b in blocks)
        odds = model.prior + (model.slope * saved + model.lean * len(data)) / (len(data) + 48)
        assert r["quality_score"] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, odds)))), abs=1e-9)
    kept = quality.keep(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["quality_score"] >= 0.5}
