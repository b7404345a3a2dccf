import base64
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from likeness.llm import packing, queries

TEXTS = ["", None, "one", "Don't   stop\n\n here\tnow  ", "é𝒳     x\x1cy \x85 z", "word " * 7000, " lead", "trail \n", "a" * 3000, "\n \n", "naïve 12345 !!"]


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder()


def test_encoding_by_words_equals_encoding_whole(encoder, data):
    import pyarrow.parquet as pq

    texts = TEXTS + pq.read_table(f"{data}/documents.parquet")["text"].to_pylist()
    for t in texts:
        ids = np.frombuffer(encoder.encode(t), "<u2").tolist()
        assert ids == encoder.encoding.encode_ordinary(t or "")


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(" \n\t  ab1'!s\x1cé"), max_size=30))
def test_encoding_any_white_space(text):
    global ENCODER
    ENCODER = globals().get("ENCODER") or packing.Encoder()
    assert np.frombuffer(ENCODER.encode(text), "<u2").tolist() == ENCODER.encoding.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_is_best_fit_decreasing(sizes):
    rooms, expected = [], []
    for n in sorted(range(len(sizes)), key=lambda n: (-sizes[n], n)):
        fits = [r for r in rooms if r >= sizes[n]]
        if fits:
            rooms[rooms.index(min(fits))] -= sizes[n]
        else:
            rooms.append(20 - sizes[n])
    expected = sorted(rooms)
    rows = packing.best_fit(sizes, 20)
    assert sorted(n for r in rows for n in r) == list(range(len(sizes)))
    assert sorted(20 - sum(sizes[n] for n in r) for r in rows) == expected


def test_round_trip(spark, encoder, monkeypatch):
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choice(["alpha", "beta", "ga", "é"]) for _ in range(rng.randint(0, 400)))) for i in range(200)]
    rows += [(None, "no id"), (101, rows[12][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int")
    monkeypatch.setattr(packing, "SHARD_TOKENS", 3000)
    folder, table = packing.pack(df, row=128)
    pieces, kept = {}, table.collect()
    files = {name: packing.read_shard(folder, name) for name in {r["shard"] for r in kept}}
    for r in kept:
        matrix, ends, position = files[r["shard"]]
        assert ends[r["row"]].tolist() == r["cu_seqlens"] and r["cu_seqlens"][-1] == r["n_tokens"]
        ids = matrix[r["row"]]
        assert (ids[r["n_tokens"] :] == encoder.pad).all()
        for doc, start, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert position[r["row"]][a:b].tolist() == list(range(b - a))
            pieces.setdefault(doc, []).append((start, ids[a:b].tolist()))
        assert r["position_resets"] == [e for e in r["cu_seqlens"] if e < 128]
        assert position[r["row"]][r["n_tokens"] :].tolist() == list(range(128 - r["n_tokens"]))
    for doc, text in rows:
        expected = encoder.encoding.encode_ordinary(text or "")
        parts = sorted(pieces.get(doc, []))
        parts = parts[::2] if doc == 101 else parts
        assert [i for _, p in parts for i in p] == expected
        assert encoder.encoding.decode(expected) == (text or "")
    assert packing.checked(folder, table).where("length(ids_sha256) = 64").count() == len(kept)


def test_query_matches_a_plain_packing(spark, encoder, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "ga", "é\\n"]) for _ in range(rng.randint(0, 1500)))) for i in range(60)] + [(70, None), (71, "word " * 9000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_packing(spark, str(tmp_path)).collect()
    row, pieces = packing.ROW, []
    for doc, text in rows:
        ids = encoder.encoding.encode_ordinary(text or "")
        pieces += [(doc, at, ids[at : at + row]) for at in range(0, len(ids), row)]
    bins = []
    for piece in sorted(pieces, key=lambda p: -len(p[2])):
        room = lambda b: row - sum(len(p[2]) for p in b)
        fits = [b for b in bins if room(b) >= len(piece[2])]
        if fits:
            min(fits, key=room).append(piece)
        else:
            bins.append([piece])
    # Which of several rows with equal room takes a piece is open; the rooms are not, nor is what a row's digest covers.
    assert sorted(r["n_tokens"] for r in got) == sorted(sum(len(p[2]) for p in b) for b in bins)
    by = {(d, at): ids for d, at, ids in pieces}
    assert sorted((d, at) for r in got for d, at in zip(r["doc_ids"], r["doc_starts"])) == sorted(by)
    for r in got:
        ids = [x for d, at in zip(r["doc_ids"], r["doc_starts"]) for x in by[d, at]]
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids + [encoder.pad] * (row - len(ids)), "<u2").tobytes()).hexdigest()
    again = {tuple(x) for x in queries.op10_packing(spark, str(tmp_path)).select("shard", "row", "ids_sha256").collect()}
    assert again == {(r["shard"], r["row"], r["ids_sha256"]) for r in got}


def test_large_vocabularies_take_four_bytes(tmp_path):
    ranks = [bytes([n]) for n in range(256)] + [n.to_bytes(3, "big") for n in range(70_000)]
    (tmp_path / "v").write_text("".join(f"{base64.b64encode(b).decode()} {n}\n" for n, b in enumerate(ranks)))
    encoder = packing.Encoder(str(tmp_path / "v"))
    assert (encoder.pad, encoder.kind) == (70_256, "<u4") and np.frombuffer(encoder.encode("ab"), "<u4").tolist() == [97, 98]
    folder = f"file://{tmp_path}/out"
    rows = packing.write_shard(folder, [(1, encoder.encode("abc")), (2, encoder.encode("xy"))], 4, encoder.kind, encoder.pad, "p")
    matrix, ends, position = packing.read_shard(folder, rows[0]["shard"])
    assert matrix.tolist() == [[97, 98, 99, 70_256], [120, 121, 70_256, 70_256]] and position.tolist() == [[0, 1, 2, 0], [0, 1, 0, 1]]
    assert packing.read_ids(folder, rows[0]["shard"]).tolist() == matrix.tolist()


def test_empty_table(spark):
    folder, table = packing.pack(spark.createDataFrame([], "doc_id long, text string"))
    assert table.count() == packing.checked(folder, table).count() == 0
