"""Benchmark decontamination under edit distance, by CGK embedding and bit-sampling LSH.

Texts and benchmark items are sequences of lower-cased words. An item occurs in a document if some
stretch of the document is within ``edits`` of the item's words of it, by insertions, deletions and
replacements. An item-sized window starts at every word from which on the document holds so many of the
benchmark's word pairs as every stretch within the limit holds. Windows and items are embedded by the
same random walks, which turn edit distance into Hamming distance; coordinates sampled from the embedding
are a bucket's key, and the items in a window's buckets are its candidates. The number of walks is
planned for the target recall. What meets is verified by the exact edit distance.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import file_system, fill, materialize, shared_path, slices

EDITS, TARGET_RECALL, SEED = 0.2, 0.999, 11
#: Coordinates that must agree, and samples drawn from one walk.
SAMPLED, SAMPLES_PER_WALK = 2, 4
#: Outputs of the embedding per word, and the first share of them that is sampled: by then a walk has run
#: through three quarters of its row; later outputs are ever more often fill, which agrees for any two rows.
OUTPUTS, SAMPLED_SHARE = 3, 0.5
#: If so many walks do not reach the target, planning fails with the recall reached.
MOST_WALKS = 256
#: Benchmark text that a worker indexes at a time; a larger benchmark is handled in several passes.
BLOCK_BYTES = 4_000_000
#: Windows embedded, and candidates verified, at a time.
ROWS = 4096
_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _moves(n_symbols: int, steps: int, walk: int):
    """Per step and symbol a random bit: whether the walk moves on."""
    import numpy as np

    symbol = np.arange(n_symbols, dtype=np.uint64)[None, :]
    step = np.array([(s * 1_000_003 + walk * 7_919 + SEED) * 0xD1B54A32D192ED03 % 2**64 for s in range(steps)], np.uint64)[:, None]
    x = (symbol + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + step
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(63)).astype(np.uint8)


def embed(symbols, starts, moves):
    """CGK embedding of the text from each start: (symbol, words passed) at each step, one row a start.

    A row's embedding ends where it has passed the row's words; what comes after is fill, symbol 0.
    """
    import numpy as np

    out = np.empty((len(starts), len(moves)), np.int32)
    passed = np.empty((len(starts), len(moves)), np.int32)
    at, last = starts.copy(), len(symbols) - 1
    for step in range(len(moves)):
        symbol = symbols[np.minimum(at, last)]
        out[:, step], passed[:, step] = symbol, at - starts
        at = at + moves[step][symbol]
    return out, passed


@lru_cache(maxsize=1 << 16)
def _coordinates(length: int, walk: int):
    """Per sample of a walk, the steps that are compared for rows of ``length`` words."""
    import numpy as np

    share = np.random.default_rng((SEED, walk)).random((SAMPLES_PER_WALK, SAMPLED)) * SAMPLED_SHARE
    return (share * OUTPUTS * length).astype(np.int64)


def _steps(longest: int) -> int:
    return max(1, math.ceil(SAMPLED_SHARE * OUTPUTS * longest))


def bucket_keys(embedded, length: int, walk: int, rows=slice(None)):
    """Per chosen row and sample, the key of its bucket: row length, sample and the symbols at its coordinates."""
    import numpy as np

    out, passed = embedded
    n_rows = len(out) if isinstance(rows, slice) else len(rows)
    keys = np.empty((n_rows, SAMPLES_PER_WALK), np.uint64)
    for n, steps in enumerate(_coordinates(length, walk)):
        x = np.full(n_rows, (length * 7919 + walk * SAMPLES_PER_WALK + n) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
        for step in steps:
            symbol = np.where(passed[rows, step] < length, out[rows, step], 0).astype(np.uint64)
            x = (x ^ symbol) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
        keys[:, n] = x
    return keys


def alignments(items, texts):
    """(distance, end) of the stretch of each text nearest to its item; the earliest end among equals.

    Items are of one length; texts are padded at their ends with a symbol that no item holds.
    """
    import numpy as np

    index = np.arange(texts.shape[1] + 1)
    row = np.zeros((len(texts), texts.shape[1] + 1), np.int64)
    for n in range(items.shape[1]):
        below = np.minimum(row[:, :-1] + (texts != items[:, n : n + 1]), row[:, 1:] + 1)
        row = np.concatenate([np.full((len(texts), 1), n + 1), below], axis=1) - index
        row = np.minimum.accumulate(row, axis=1) + index
    end = row.argmin(axis=1)
    return row[np.arange(len(row)), end], end


@dataclass(frozen=True)
class Benchmark:
    """A block of benchmark items: bounded by BLOCK_BYTES of text, or by the texts of one id."""

    ids: list
    id_type: pa.DataType
    items: list  # arrays of symbols
    symbols: dict
    pairs: object  # sorted codes of word pairs
    first: object  # per code, where its lengths start
    lengths: object  # the lengths of the items that hold it
    classes: dict  # length -> (edits allowed, items)
    moves: list  # per walk, the bits that move it on
    keys: object  # sorted keys of the items' buckets
    holds: object  # the item of each
    marks: object  # and a mark at the last bits of each, so that most keys without items need no search

    @property
    def longest(self) -> int:
        return max(self.classes, default=0)

    @property
    def room(self) -> int:
        """Fill between texts laid end to end, so that no window or stretch spans two."""
        return self.longest + max((k for k, _ in self.classes.values()), default=0) + 2


def _met(a, b, length: int, walk: int):
    return (bucket_keys(a, length, walk) == bucket_keys(b, length, walk)).any(axis=1)


def _planned_walks(classes: dict, items: list, n_symbols: int, target: float) -> list:
    """Walks by which a stretch with as many edits as allowed meets its item with the target's probability."""
    import numpy as np

    if not items:
        return []
    rng = np.random.default_rng(SEED)
    longest = max(classes)
    chosen = sorted((int(i) for i in rng.integers(0, len(items), size=400)), key=lambda i: len(items[i]))
    width = 2 * longest + 2
    left, right = np.zeros((400, width), np.int64), np.zeros((400, width), np.int64)
    for n, i in enumerate(chosen):
        words = items[i].tolist()
        left[n, : len(words)] = words
        for _ in range(classes[len(items[i])][0]):
            at, kind = int(rng.integers(0, len(words))), int(rng.integers(0, 3))
            words[at : at + 1] = ([0], [], [0, words[at]])[kind]
        right[n, : len(words)] = words
    starts, lengths = np.arange(400) * width, np.array([len(items[i]) for i in chosen])
    met, walks = np.zeros(400, bool), []
    while met.mean() < target:
        if len(walks) == MOST_WALKS:
            raise ValueError(f"{MOST_WALKS} walks reach a recall of {met.mean():.3f}, the target is {target}; allow fewer edits or a lower target")
        moves, walk = _moves(n_symbols, _steps(longest), len(walks)), len(walks)
        a, b = (embed(x.ravel(), starts, moves) for x in (left, right))
        for length in np.unique(lengths):
            own = lengths == length
            met[own] |= _met(*[tuple(x[own] for x in e) for e in (a, b)], int(length), walk)
        walks.append(moves)
    return walks


def index(rows: list[tuple[object, str]], edits: float = EDITS, target: float = TARGET_RECALL, id_type: pa.DataType | None = None) -> Benchmark:
    """Index benchmark items (id, text). Repeated items count once; ids may be null; items without words take no part."""
    import numpy as np

    if not 0 <= edits < 1:
        raise ValueError(f"edits is a share of an item's words below 1, not {edits}")
    symbols: dict[str, int] = {}
    ids, items, seen = [], [], set()
    for i, text in rows:
        words = tokens(text)
        if not words or (i, tuple(words)) in seen:
            continue
        seen.add((i, tuple(words)))
        ids.append(i)
        items.append(np.array([symbols.setdefault(w, len(symbols) + 1) for w in words], np.int64))
    base = len(symbols) + 1
    code = [np.stack([x[:-1] * base + x[1:], np.full(len(x) - 1, len(x))]) for x in items]
    code = np.unique(np.concatenate([np.empty((2, 0), np.int64), *code], axis=1), axis=1)
    pairs, first = np.unique(code[0], return_index=True)
    by_length: dict[int, list[int]] = {}
    for n, item in enumerate(items):
        by_length.setdefault(len(item), []).append(n)
    classes = {m: (int(edits * m + 1e-9), np.array(ns)) for m, ns in sorted(by_length.items())}
    moves, keys, holds = _planned_walks(classes, items, base, target), [], []
    for walk, bits in enumerate(moves):
        for m, (_, ns) in classes.items():
            for lo in range(0, len(ns), ROWS):
                part = ns[lo : lo + ROWS]
                flat = np.concatenate([*[items[n] for n in part], np.zeros(1, np.int64)])
                found = bucket_keys(embed(flat, np.arange(len(part)) * m, bits), m, walk)
                keys.append(found.ravel())
                holds.append(np.repeat(part, SAMPLES_PER_WALK))
    keys, holds = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (keys, holds))
    order = np.argsort(keys, kind="stable")
    marks = np.zeros(1 << max(16, (32 * len(keys)).bit_length()), bool)
    marks[(keys & np.uint64(len(marks) - 1)).astype(np.int64)] = True
    return Benchmark(ids, id_type, items, symbols, pairs, np.append(first, code.shape[1]), code[1], classes, moves, keys[order], holds[order].astype(np.int64), marks)


def _openings(at, need: int, width: int):
    """All starts of stretches of ``width`` that hold ``need`` of the sorted positions ``at``."""
    import numpy as np

    first, last = at[: max(len(at) - need + 1, 0)], at[need - 1 :]
    near = last - first < width
    hi, lo = first[near], last[near] - width + 1
    lo[1:] = np.maximum(lo[1:], hi[:-1] + 1)
    sizes = hi - lo + 1
    return np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _padded(arrays):
    import numpy as np

    out = np.full((len(arrays), max(map(len, arrays))), -1, np.int64)
    for row, x in zip(out, arrays, strict=True):
        row[: len(x)] = x
    return out


class Matcher:
    """Finds a benchmark block's items in batches of texts."""

    def __init__(self, bench: Benchmark):
        self.bench = bench

    def _laid(self, texts: list[str | None]):
        """Symbols of all texts end to end with room between, where each begins, and its number of words."""
        import numpy as np

        get, room = self.bench.symbols.get, self.bench.room
        split = [tokens(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        begins = np.cumsum(counts + room) - counts
        symbols = np.zeros(int((counts + room).sum()) + room, np.int64)
        for b, words in zip(begins.tolist(), split, strict=True):
            symbols[b : b + len(words)] = [get(w, 0) for w in words]
        return symbols, begins, counts

    def windows(self, symbols) -> dict:
        """Per length of items, where windows start: at every word from which on enough stays of some stretch within the limit.

        An edit spoils two pairs of words at most, or one word where that would leave no pair. Only pairs that
        items of that length hold are counted.
        """
        import numpy as np

        known = symbols > 0
        word = np.nonzero(known)[0]
        both = np.nonzero(known[:-1] & known[1:])[0]
        codes, pairs = symbols[both] * (len(self.bench.symbols) + 1) + symbols[both + 1], self.bench.pairs
        place = np.searchsorted(pairs, codes)
        place[place == len(pairs)] = 0
        hit = np.nonzero(pairs[place] == codes)[0] if len(pairs) else both[:0]
        sizes = self.bench.first[place[hit] + 1] - self.bench.first[place[hit]]
        entry = np.repeat(self.bench.first[place[hit]] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        pair, held = np.repeat(both[hit], sizes), self.bench.lengths[entry]
        found = {}
        for m, (k, _) in self.bench.classes.items():
            stay = m - 1 - 2 * k
            found[m] = _openings(pair[held == m], stay, m + k - 1) if stay > 0 else _openings(word, m - k, m + k)
        return found

    def meetings(self, symbols, windows: dict):
        """(start, item) of the windows and the items in their buckets."""
        import numpy as np

        keys, holds, marks = self.bench.keys, self.bench.holds, self.bench.marks
        every = np.unique(np.concatenate(list(windows.values()))) if windows else np.empty(0, np.int64)
        out = [np.empty((2, 0), np.int64)]
        for lo in range(0, len(every), ROWS):
            starts = every[lo : lo + ROWS]
            own = {}
            for m, at in windows.items():
                a, b = np.searchsorted(at, (starts[0], starts[-1] + 1))
                if b > a:
                    own[m] = np.searchsorted(starts, at[a:b])
            for walk, moves in enumerate(self.bench.moves):
                embedded = embed(symbols, starts, moves)
                for m, rows in own.items():
                    asked = bucket_keys(embedded, m, walk, rows).ravel()
                    hit = np.nonzero(marks[(asked & np.uint64(len(marks) - 1)).astype(np.int64)])[0]
                    if not len(hit):
                        continue
                    first = np.searchsorted(keys, asked[hit])
                    sizes = np.searchsorted(keys, asked[hit], side="right") - first
                    posting = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
                    out.append(np.stack([np.repeat(starts[rows[hit // SAMPLES_PER_WALK]], sizes), holds[posting]]))
            if sum(x.shape[1] for x in out) > 1 << 20:
                out = [np.unique(np.concatenate(out, axis=1), axis=1)]
        return np.unique(np.concatenate(out, axis=1), axis=1)

    def find(self, texts: list[str | None]) -> dict[tuple[int, object], tuple[int, int, int, int]]:
        """(text number, item id) -> (distance, first word, words, words of the item), the nearest stretch."""
        import numpy as np

        best: dict[tuple[int, object], tuple[int, int, int, int]] = {}
        if not self.bench.items or not texts:
            return best
        symbols, begins, counts = self._laid(texts)
        start, item = self.meetings(symbols, self.windows(symbols))
        doc = np.maximum(np.searchsorted(begins, start, side="right") - 1, 0)
        inside = (start >= begins[doc]) & (start < begins[doc] + counts[doc])
        start, item, doc = start[inside], item[inside], doc[inside]
        length = np.array([len(x) for x in self.bench.items])[item]
        order = np.lexsort((start, doc, item, length))
        start, item, doc, length = (x[order] for x in (start, item, doc, length))
        # Starts of one text and item that are less than an item apart are verified together, in one region.
        new = np.ones(len(start), bool)
        new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] - start[:-1] > length[1:])
        first = np.nonzero(new)[0]
        last = np.append(first[1:], len(start)) - 1 if len(first) else first
        for m, (k, _) in self.bench.classes.items():
            a, b = np.searchsorted(length[first], (m, m + 1))
            for lo in range(a, b, ROWS):
                f, e = first[lo : min(lo + ROWS, b)], last[lo : min(lo + ROWS, b)]
                begin, over = begins[doc[f]], begins[doc[f]] + counts[doc[f]]
                left, right = np.maximum(start[f] - k, begin), np.minimum(start[e] + m + k, over)
                regions = [symbols[x:y] for x, y in zip(left.tolist(), right.tolist(), strict=True)]
                items = np.stack([self.bench.items[i] for i in item[f]])
                distance, end = alignments(items, _padded(regions))
                near = np.nonzero(distance <= k)[0]
                if not len(near):
                    continue
                turned = _padded([np.append(regions[n][: end[n]][::-1], -1) for n in near.tolist()])
                _, words = alignments(items[near, ::-1], turned)
                for n, w in zip(near.tolist(), words.tolist(), strict=True):
                    key = int(doc[f[n]]), self.bench.ids[item[f[n]]]
                    value = int(distance[n]), int(left[n] - begin[n] + end[n] - w), w, m
                    best[key] = min(best.get(key, value), value)
        return best


@lru_cache(maxsize=1)
def _loaded(folder: str, block: int, edits: float, target: float) -> Matcher:
    """The matcher of a stored block; a worker keeps one."""
    import pyarrow.parquet as pq

    fs, path = file_system(f"{folder}/block={block}")
    from pyarrow import fs as filesystems

    files = [f.path for f in fs.get_file_info(filesystems.FileSelector(path)) if f.path.endswith(".parquet")]
    table = pa.concat_tables([pq.read_table(f, filesystem=fs, partitioning=None) for f in sorted(files)])
    ids, texts = table["item_id"].to_pylist(), table["text"].to_pylist()
    rows = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is not None, r))
    return Matcher(index(rows, edits, target, table["item_id"].type))


def _stored(benchmark: DataFrame) -> tuple[str, list[int]]:
    """The distinct rows of the benchmark in the shared folder, in blocks of about BLOCK_BYTES; an id is in one block.

    The driver sees the numbers of the blocks only.
    """
    spark = benchmark.sparkSession
    rows = benchmark.select("item_id", fill(F.col("text")).alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder, n = shared_path(spark, "benchmark"), max(1, math.ceil(size / BLOCK_BYTES))
    rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int")).write.partitionBy("block").parquet(folder)
    if not size:
        return folder, []
    blocks = spark.read.schema("text string, block int").parquet(folder).select("block").distinct()
    return folder, sorted(r["block"] for r in blocks.collect())


def matches(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, target: float = TARGET_RECALL) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, distance, similarity``: the nearest stretch per document and item.

    Words are runs of letters, digits and underscores in lower case; positions count such words from
    0. ``edits`` is a share below 1 of an item's words, rounded down, so short items (below five words, at 0.2) match
    only word for word, which is found with certainty. Items without words, and null ones, take no part; documents
    without words match nothing. Repeated rows of ``docs`` repeat in the result, repeated items do not; texts
    that share an item_id count as one item, whose nearest stretch is told. Null ids pass through. Among
    equally near stretches the first is told. Empty tables give an empty result; other columns are ignored.
    Texts are searched whole, however long.
    """
    doc_type, item_type = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {doc_type}, item_id {item_type}, start_word int, n_words int, distance int, similarity double"
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    folder, blocks = _stored(benchmark)
    out = docs.sparkSession.createDataFrame([], schema)
    for n, block in enumerate(blocks):

        def run(batches, block=block):
            matcher = _loaded(folder, block, edits, target)
            for batch in batches:
                for part, (texts,) in slices(batch, ["text"]):
                    best = matcher.find(texts)
                    table = [(n, i, s, w, d, 1 - d / m) for (n, i), (d, s, w, m) in best.items()]
                    doc, item, *rest = zip(*table, strict=True) if table else [()] * 6
                    cols = [part.column(0).take(pa.array(doc, pa.int64())), pa.array(item, matcher.bench.id_type)]
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64())
                    cols += [pa.array(c, k) for c, k in zip(rest, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"])

        part = chosen.mapInArrow(run, schema)
        out = out.unionByName(part) if n else part
    return out


def clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, target: float = TARGET_RECALL) -> DataFrame:
    """``docs`` without the rows in which some benchmark item occurs, as ``matches`` defines it; all columns pass through.

    Null and empty texts stay. Of repeated rows all go or all stay. Without items, or without documents, nothing
    changes. Each block of the benchmark after the first costs a pass over what is left, through the shared folder.
    """
    folder, blocks = _stored(benchmark)
    for n, block in enumerate(blocks):

        def run(batches, block=block):
            matcher = _loaded(folder, block, edits, target)
            for batch in batches:
                for part, (texts,) in slices(batch, ["text"]):
                    leaks = {n for n, _ in matcher.find(texts)}
                    yield part.filter(pa.array([n not in leaks for n in range(len(texts))], pa.bool_()))

        docs = (materialize(docs, "cleaned") if n else docs).mapInArrow(run, docs.schema)
    return docs
