"""Quality classifier by compression: two zstandard dictionaries compete for every block of a text.

A dictionary trained on good text shortens good text more than one trained on bad text does. A
document is cut into blocks, each compressed on its own with either dictionary, so that long
documents keep being judged by the dictionaries and not by their own beginning. The difference of
the two sizes, divided by the raw size, goes through a logistic curve fitted on labelled documents
that the dictionaries have not seen. The curve passes through the share of good labels for a text without
bytes, and short texts stay near it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import fill, materialize, slices

#: Fitting reads at most so many labelled documents of each class and so many bytes of their text.
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 24_000_000
DICT_BYTES, BLOCK, LEVEL = 65_536, 512, 3
#: A text's size counts as so many bytes more; keeps very short texts near the share of good labels.
PRIOR_BYTES = 48


@dataclass(frozen=True)
class CompressionModel:
    """Everything a scorer needs; a few times DICT_BYTES, whatever the corpus."""

    good: bytes
    bad: bytes
    raw: bool
    #: Log odds of a good label, the weight of the bytes saved per byte, and the weight of there being bytes.
    prior: float
    slope: float
    lean: float

    def scorer(self):
        import zstandard

        kind = zstandard.DICT_TYPE_RAWCONTENT if self.raw else zstandard.DICT_TYPE_FULLDICT
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}

        def squeeze(data: bytes):
            if not data:
                return zstandard.ZstdCompressor(**plain)
            book = zstandard.ZstdCompressionDict(data, dict_type=kind)
            book.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=book, **plain)

        good, bad = squeeze(self.good), squeeze(self.bad)

        def features(text: str | None) -> tuple[float, float]:
            """Bytes that the good dictionary saves over the bad one, and raw bytes, both over raw bytes and PRIOR_BYTES."""
            data = (text or "").encode("utf-8", "surrogatepass")
            saved = 0
            for at in range(0, len(data), BLOCK):
                block = data[at : at + BLOCK]
                saved += len(bad.compress(block)) - len(good.compress(block))
            return saved / (len(data) + PRIOR_BYTES), len(data) / (len(data) + PRIOR_BYTES)

        return features

    def probability(self, saved: float, size: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, self.prior + self.slope * saved + self.lean * size))))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are kept for testing: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[int, str]], dict[int, int]]:
    """At most SAMPLE_DOCS documents of each class, in an order that a hash of the id gives; how many each class has in all."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("_quality"))
        .withColumn("_turn", F.xxhash64("doc_id"))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
    )
    known = materialize(known, "quality-labels")
    chosen = None
    for quality in (0, 1):
        part = known.where(F.col("_quality") == quality).orderBy("_turn", "doc_id").limit(SAMPLE_DOCS)
        chosen = part if chosen is None else chosen.unionByName(part)
    counts = {r["_quality"]: r["n"] for r in known.where(F.col("_quality").isin(0, 1)).groupBy("_quality").agg(F.count("*").alias("n")).collect()}
    texts = docs.select("doc_id", fill(F.col("text")).alias("_text"))
    # The chosen side has 2 * SAMPLE_DOCS rows of three numbers at most, so it is broadcast.
    # An id that many rows repeat counts once, however many there are.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_quality", "_turn").agg(F.min("_text").alias("_text"))
    rows = materialize(rows.withColumn("_bytes", F.octet_length("_text")), "quality-sample")
    # A text that no longer fits is left out by itself; those after it are taken as long as they fit.
    room, taken = {0: SAMPLE_BYTES // 2, 1: SAMPLE_BYTES // 2}, []
    for r in rows.select("doc_id", "_quality", "_turn", "_bytes").orderBy("_turn", "doc_id").collect():
        if r["_bytes"] <= room[r["_quality"]]:
            room[r["_quality"]] -= r["_bytes"]
            taken.append(r["doc_id"])
    rows = rows.where(F.col("doc_id").isin(taken))
    return [(r["_quality"], r["_text"]) for r in rows.orderBy("_turn", "doc_id").collect()], counts


def _dictionary(texts: list[str], size: int) -> tuple[bytes, bool]:
    """A trained dictionary, or the start of the text itself where there is too little to train on."""
    import zstandard

    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    blocks = [d[at : at + BLOCK] for d in data for at in range(0, len(d), BLOCK)]
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes(), False
    except (zstandard.ZstdError, MemoryError):
        return b"".join(blocks)[:size], True


def _logistic(x, y: list[int], weight: list[float], prior: float) -> tuple[float, float]:
    """Weights of two features by Newton's method, log odds ``prior`` where both are zero, with a slight pull to zero."""
    import numpy as np

    x, y, weight = np.asarray(x, dtype=float), np.asarray(y, dtype=float), np.asarray(weight)
    spread = np.maximum(np.sqrt((x**2).mean(axis=0)), 1e-9)
    design, w = x / spread, np.zeros(2)
    # The saved bytes are centred for the pull's sake: what it weakens is their deviation, not the mean.
    mean = design[:, 0].mean() / max(design[:, 1].mean(), 1e-9)
    design[:, 0] -= mean * design[:, 1]
    pull = np.array([0.02, 1e-6]) * len(x) ** 0.5
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(prior + design @ w, -30, 30)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(pull), design.T @ (weight * (y - p)) - pull * w)
        w += np.clip(step, -4, 4)
    return float(w[0] / spread[0]), float((w[1] - w[0] * mean) / spread[1])


def fit(docs: DataFrame, labels: DataFrame) -> CompressionModel:
    """Fit on a bounded sample of labelled documents that are not held out.

    Every second sampled document of a class goes to its dictionary, the rest set the curve. There a
    class weighs as much as it has labelled documents in all, however few of them are sampled. Where
    a class has no labelled document with text, as in empty tables, the model gives one half to everything. Repeated
    labels of a document count once, the lowest; labels without a document, and null labels, are ignored. Of
    rows that repeat an id, the smallest text counts. A text that exceeds the bound on bytes is left out by itself.
    """
    sample, counts = _labelled_sample(docs, labels)
    by_class = {q: [t for k, t in sample if k == q and t] for q in (0, 1)}
    if not by_class[0] or not by_class[1]:
        return CompressionModel(b"", b"", True, 0.0, 0.0, 0.0)
    books = {q: texts[::2] for q, texts in by_class.items()}
    curve = {q: texts[1::2] or texts for q, texts in by_class.items()}
    size = min(DICT_BYTES, max(256, min(sum(len(t.encode("utf-8", "surrogatepass")) for t in b) for b in books.values()) // 3))
    (bad, raw_bad), (good, raw_good) = (_dictionary(books[q], size) for q in (0, 1))
    if raw_bad != raw_good:  # two books of one kind, so that neither has an edge by its form
        join = lambda texts: "".join(texts).encode("utf-8", "surrogatepass")[:size]
        bad, good, raw_bad = join(books[0]), join(books[1]), True
    features = CompressionModel(good, bad, raw_bad, 0.0, 0.0, 0.0).scorer()
    x = {q: [features(t) for t in texts] for q, texts in curve.items()}
    share = {q: counts[q] / sum(counts.values()) * (len(x[0]) + len(x[1])) / len(x[q]) for q in (0, 1)}
    prior = math.log(counts[1] / counts[0])
    slope, lean = _logistic(x[0] + x[1], [0] * len(x[0]) + [1] * len(x[1]), [share[0]] * len(x[0]) + [share[1]] * len(x[1]), prior)
    return CompressionModel(good, bad, raw_bad, prior, slope, lean)


def _scored(batch, model: CompressionModel):
    """Parts of an Arrow batch, and the scores of their rows."""
    features = model.scorer()
    for part, (texts,) in slices(batch, ["text"]):
        yield part, [model.probability(*features(t)) for t in texts]


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1, higher is better), of the whole text, however long.

    Null and empty texts get the share of good labels. Rows are scored one by one, so repeated rows
    get the same score; an empty table stays empty. A column named quality_score is replaced, all others pass through.
    """
    kept = docs.drop("quality_score")
    schema = kept.select("*", F.lit(0.0).alias("quality_score")).schema

    def run(batches):
        for batch in batches:
            for part, scores in _scored(batch, model):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, "quality_score"])

    return kept.mapInArrow(run, schema)


def keep(docs: DataFrame, model: CompressionModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more, as they are, whatever their columns are called."""

    def run(batches):
        for batch in batches:
            for part, scores in _scored(batch, model):
                yield part.filter(pa.array([s >= least for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
