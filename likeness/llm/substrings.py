"""Repeated passages by relative Lempel-Ziv parsing of every document against the whole corpus.

The corpus itself is the reference, indexed in blocks. Any 20 words contain an anchor, the smallest of
their 5-gram hashes, so anchors are a sampled index that no passage of 20 words escapes, and an anchor's
leading bits name the block that all windows around it belong to. A document is cut into segments where
its anchors occur a second time in the corpus, and each segment, with its words, goes to its block. There
it is parsed greedily against all segments that come before it: the first window that has occurred
opens a factor, copied from the window's first occurrence, and the factor goes on for as long as the words of
both agree. Where it ends, each window that the boundary cuts is looked up in turn, and the next that has occurred opens the next
factor, so no repeated window is lost between two factors. Factors are at least one window long; they are
the spans that go. Hashes only find windows; that they are equal is decided by their words.

Records travel packed, many to a row. Each slice of documents is first a block of its own: what it
repeats within itself is settled there, so a passage that a third of all documents share
reaches its block once per slice. In large corpora, blocks are first parsed in parts, and only what is new in
its part reaches the whole block.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import fill

WINDOW, GRAM = 20, 5
#: Vocabulary entries a worker remembers before it starts over.
REMEMBERED = 500_000
#: Odd multipliers of the rolling hashes.
_GRAM_BASE, _KEY_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Text bytes per index block, and how many blocks there may be, as powers of two.
BLOCK_BYTES, LEAST_BITS, MOST_BITS = 2_000_000, 5, 24
#: Text bytes from which on blocks are parsed in two parts first, in four from the double, and so on up to so many.
PART_BYTES, MOST_PARTS = 64_000_000_000, 4096
#: Text bytes per task where whole texts are shuffled.
TASK_BYTES = 64_000_000
#: Documents of a slice, which is parsed as a block of its own before its segments are dealt to blocks.
SLICE_DOCS = 2048
#: Bits of a document's join key, and of an anchor's mark. Coinciding keys or marks only add look-ups.
KEY_BITS, MARK_BITS = 40, 24
_LAST_ID = 2**63 - 1


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _words(texts: list[str | None], hashes: _WordHashes):
    """Word hashes of all texts in one array, and the number of words of each text."""
    import numpy as np

    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    values = np.fromiter((v for words in split for v in map(hashes.__getitem__, words)), np.uint64, int(counts.sum()))
    return values, counts


def _rolled(values, at, length: int, base: int):
    """Hash of ``length`` words from each position ``at``."""
    import numpy as np

    out, base = np.zeros(len(at), np.uint64), np.uint64(base)
    for j in range(length):
        out = out * base + values[at + j]
    return _mixed(out)


def _anchors(values, counts, window: int, gram: int):
    """Positions and hashes of anchors; starts of whole windows and their anchors' hashes; over texts laid end to end."""
    import numpy as np

    none = np.empty(0, np.int64)
    if len(values) < window:
        return none, np.empty(0, np.uint64), none, np.empty(0, np.uint64)
    base = np.uint64(_GRAM_BASE)
    grams = np.zeros(len(values) - gram + 1, np.uint64)
    for j in range(gram):
        grams = grams * base + values[j : j + len(grams)]
    grams = _mixed(grams)
    span = window - gram + 1

    def sliding(x, width: int, pick):
        done = 1
        while done < width:
            step = min(done, width - done)
            x = pick(x[: len(x) - step], x[step:])
            done += step
        return x

    least = sliding(grams, span, np.minimum)
    doc = np.repeat(np.arange(len(counts)), counts)
    whole = doc[: len(least)] == doc[window - 1 :]
    least = np.where(whole, least, np.uint64(0))
    pad = np.zeros(span - 1, np.uint64)
    greatest = sliding(np.concatenate([pad, least, pad]), span, np.maximum)
    at = np.nonzero((grams == greatest) & (greatest > 0))[0]
    starts = np.nonzero(whole)[0]
    return at, grams[at], starts, least[starts]


def _starts(*sorted_keys):
    """Where a new combination of values starts in arrays sorted by them."""
    import numpy as np

    if not len(sorted_keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(sorted_keys[0]), bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.nonzero(new)[0]


def _binary(starts, records) -> pa.Array:
    """The records from each start to the next, as one binary value each."""
    import numpy as np

    ends = np.append(starts, len(records)) * records.dtype.itemsize
    buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(records.tobytes())]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).cast(pa.binary())


def _located(batch, text: str):
    """(rows, their text) up to 512 at a time."""
    for at in range(0, batch.num_rows, 512):
        part = batch.slice(at, 512)
        yield part, part.column(part.schema.get_field_index(text)).to_pylist()


def _numpy(batch, name: str):
    return batch.column(batch.schema.get_field_index(name)).to_numpy()


def _keyed(docs: DataFrame) -> DataFrame:
    """``dk, did, th, text``: a document is known by its id (null: after all others) and its text's hash."""
    text = fill(F.col("text"))
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))
    return named.select(F.xxhash64("did", "th").bitwiseAND(F.lit(2**KEY_BITS - 1)).alias("dk"), "did", "th", "text")


def _text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length(fill(F.col("text"))))).first()[0] or 0


def _block_bits(size: int) -> int:
    return max(LEAST_BITS, min(MOST_BITS, (size // BLOCK_BYTES).bit_length()))


def _anchor_places(keyed: DataFrame, bits: int, window: int, gram: int) -> DataFrame:
    """``block, once, again``: packed anchors by block; those a batch holds more than once also under ``again``."""

    def run(batches):
        import numpy as np

        hashes = _WordHashes()
        once, again = np.dtype([("h", "<u8"), ("k", "<u4"), ("j", "u1")]), np.dtype([("k", "<i8"), ("m", "<i4")])
        for batch in batches:
            keys, docs = [], []
            for part, texts in _located(batch, "text"):
                values, counts = _words(texts, hashes)
                at, h, _, _ = _anchors(values, counts, window, gram)
                keys.append(h)
                docs.append(_numpy(part, "dk")[np.searchsorted(np.cumsum(counts), at, side="right")])
            h, doc = np.concatenate(keys) if keys else np.empty(0, np.uint64), np.concatenate(docs) if docs else np.empty(0, np.int64)
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            first = _starts(h)
            size = np.diff(np.append(first, len(h)))
            # An anchor that the batch repeats: settled for its places here; its block gets it twice, so as to count it repeated.
            multiple = np.repeat(size > 1, size)
            keep = np.zeros(len(h), bool)
            keep[first] = keep[first[size > 1] + 1] = True
            rec = np.empty(int(keep.sum()), once)
            rec["h"], rec["k"], rec["j"] = h[keep], doc[keep] & 0xFFFFFFFF, doc[keep] >> 32
            done = np.empty(int((multiple & ~keep).sum()), again)
            done["k"], done["m"] = doc[multiple & ~keep], (h[multiple & ~keep] & np.uint64(2**MARK_BITS - 1)).astype(np.int32)
            block = (rec["h"] >> np.uint64(64 - bits)).astype(np.int64)
            cut = _starts(block)
            order = np.argsort(done["k"], kind="stable")
            done = done[order]
            spread = done["k"] & (2**bits - 1)
            done, spread = done[np.argsort(spread, kind="stable")], np.sort(spread, kind="stable")
            more = _starts(spread)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([block[cut], spread[more]])), pa.concat_arrays([_binary(cut, rec), pa.nulls(len(more), pa.binary())]),
                    pa.concat_arrays([pa.nulls(len(cut), pa.binary()), _binary(more, done)]),
                ],
                names=["block", "once", "again"],
            )

    return keyed.select("dk", "text").mapInArrow(run, "block long, once binary, again binary")


def _repeated_anchors(places: DataFrame) -> DataFrame:
    """``dk, mark``: documents and the anchors in them that the corpus holds more than once."""

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        once, again = np.dtype([("h", "<u8"), ("k", "<u4"), ("j", "u1")]), np.dtype([("k", "<i8"), ("m", "<i4")])
        rec = np.frombuffer(b"".join(x for x in table["once"].to_pylist() if x), once)
        done = np.frombuffer(b"".join(x for x in table["again"].to_pylist() if x), again)
        order = np.argsort(rec["h"], kind="stable")
        h = rec["h"][order]
        first = _starts(h)
        size = np.diff(np.append(first, len(h)))
        rec = rec[order][np.repeat(size > 1, size)]
        doc = rec["k"].astype(np.int64) | (rec["j"].astype(np.int64) << 32)
        mark = (rec["h"] & np.uint64(2**MARK_BITS - 1)).astype(np.int32)
        return pa.table({"dk": np.concatenate([doc, done["k"]]), "mark": np.concatenate([mark, done["m"]])})

    return places.groupBy("block").applyInArrow(run, "dk long, mark int")


#: A segment: document (id and text hash), first word, number of windows. A factor: first word, words, and where its source starts.
_SEGMENT = [("d", "<i8"), ("t", "<i8"), ("s", "<i4"), ("n", "<i4")]
_FACTOR = [("s", "<i4"), ("n", "<i4"), ("d", "<i8"), ("a", "<i4")]


def _numbered(words) -> object:
    """Numbers that are equal exactly where words are."""
    import numpy as np

    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _parse(segments, ids, window: int):
    """Greedy factors of segments against each other, and which windows have no earlier occurrence among them.

    ``segments``: records of _SEGMENT; ``ids``: the words of all of them in turn, numbered, so a segment of n windows
    has n + window - 1. Segments of one document may overlap or repeat: a window is known by document
    and first word. Returns (owner, factors, windows, new): per factor its segment and a _FACTOR record; per window its segment,
    its place there and whether it is new.
    """
    import numpy as np

    n = segments["n"].astype(np.int64)
    begins = np.cumsum(n + window - 1) - (n + window - 1)
    owner = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at, start = begins[owner] + within, segments["s"][owner] + within
    did, th = segments["d"][owner], segments["t"][owner]
    key = _rolled(ids.astype(np.uint64) + np.uint64(1), at, window, _KEY_BASE)
    # The index: windows of equal hash in order of their places. Those whose words differ from the first's are grouped again.
    left, source = np.lexsort((start, th, did, key)), np.arange(len(owner))
    while len(left):
        first = _starts(key[left])
        head = np.repeat(left[first], np.diff(np.append(first, len(left))))
        same = np.ones(len(left), bool)
        for j in range(window):
            same &= ids[at[left] + j] == ids[at[head] + j]
        source[left[same]] = head[same]
        left = left[~same]
    again = (did != did[source]) | (th != th[source]) | (start != start[source])
    # Runs of windows whose first occurrences follow each other are copied as a whole.
    opens = again.copy()
    opens[1:] &= ~(again[:-1] & (owner[1:] == owner[:-1]) & (source[1:] == source[:-1] + 1) & (owner[source[1:]] == owner[source[:-1]]))
    closes = again.copy()
    closes[:-1] &= opens[1:] | ~again[1:]
    lo, hi = np.nonzero(opens)[0], np.nonzero(closes)[0]
    copied = source[lo]
    # Windows after each in its segment. A factor goes on where its source's next word is its own next word.
    after = np.repeat(n, n) - 1 - within
    end = source[hi]
    more = (after[hi] > 0) & (after[end] > 0)
    more[more] = ids[at[hi[more]] + window] == ids[at[end[more]] + window]
    if more.any():
        lo, hi, copied = lo.tolist(), hi.tolist(), copied.tolist()
        factors, reach = [], -1
        for f, (x, y, c) in enumerate(zip(lo, hi, copied, strict=True)):
            if y <= reach:
                continue
            if x <= reach:
                x, c = reach + 1, c + reach + 1 - x
            if more[f]:
                e, room = c + y - x, min(int(after[y]), int(after[c + y - x]))
                differ = np.nonzero(ids[at[y] + window : at[y] + window + room] != ids[at[e] + window : at[e] + window + room])[0]
                y += int(differ[0]) if len(differ) else room
            factors.append((x, y, c))
            reach = y
        lo, hi, copied = (np.array(x, np.int64) for x in zip(*factors, strict=True))
    found = np.empty(len(lo), _FACTOR)
    found["s"], found["n"], found["d"], found["a"] = start[lo], hi - lo + window, did[copied], start[copied]
    return owner[lo], found, owner, within, ~again


def _by_document(did, th, factors):
    """Per document its factors, packed: did, th, hits."""
    import numpy as np

    order = np.lexsort((factors["s"], th, did))
    did, th = did[order], th[order]
    cut = _starts(did, th)
    return pa.array(did[cut], pa.int64()), pa.array(th[cut], pa.int64()), _binary(cut, factors[order])


def _new_runs(segments, owner, within, new):
    """The runs of new windows within segments: (segment, first window, windows)."""
    import numpy as np

    owner, within = owner[new], within[new]
    cut = _starts(owner, within - np.arange(len(within)))
    return owner[cut], within[cut], np.diff(np.append(cut, len(owner)))


_LOOKUPS = pa.schema(
    [("block", pa.int64()), ("part", pa.int32()), ("segments", pa.binary()), ("words", pa.binary()), ("did", pa.int64()), ("th", pa.int64()), ("hits", pa.binary())]
)


def _packed(block, part: int, segments, words: list[bytes], did, th, hits, spread) -> pa.RecordBatch:
    """Segments with their words by block, and factors that are settled, which go along anywhere."""
    import numpy as np

    order = np.argsort(block, kind="stable")
    cut = _starts(block[order])
    edges = np.append(cut, len(order)).tolist()
    texts = [b" ".join([words[i] for i in order[a:b].tolist()]) for a, b in zip(edges, edges[1:], strict=False)] if len(order) else []
    n, m = len(cut), len(did)
    empty = lambda k, kind: pa.nulls(k, kind)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([block[order][cut], spread]).astype(np.int64)), pa.array(np.full(n + m, part, np.int32)),
            pa.concat_arrays([_binary(cut, segments[order]), empty(m, pa.binary())]), pa.concat_arrays([pa.array(texts, pa.binary()), empty(m, pa.binary())]),
            pa.concat_arrays([empty(n, pa.int64()), did]), pa.concat_arrays([empty(n, pa.int64()), th]), pa.concat_arrays([empty(n, pa.binary()), hits]),
        ],
        schema=_LOOKUPS,
    )


def _segments(candidates: DataFrame, bits: int, parts: int, window: int, gram: int) -> DataFrame:
    """Segments by block, after each slice of documents has been parsed against itself."""

    def run(batches):
        import numpy as np

        hashes = _WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_DOCS):
                part = batch.slice(lo, SLICE_DOCS)
                column = lambda name: part.column(part.schema.get_field_index(name))  # noqa: B023, E731
                texts = [t.encode("utf-8", "surrogatepass").split() for t in column("text").to_pylist()]
                counts = np.fromiter(map(len, texts), np.int64, len(texts))
                values = np.fromiter((v for words in texts for v in map(hashes.__getitem__, words)), np.uint64, int(counts.sum()))
                _, _, starts, least = _anchors(values, counts, window, gram)
                offsets = np.cumsum(counts) - counts
                known = column("known")
                marked = np.repeat(np.arange(part.num_rows), np.diff(known.offsets.to_numpy()))
                # Marks of a document and its anchors, as one number each.
                wanted = (marked << MARK_BITS) + known.flatten().to_numpy()
                doc = np.searchsorted(offsets + counts, starts, side="right")
                own = (doc << MARK_BITS) + (least & np.uint64(2**MARK_BITS - 1)).astype(np.int64)
                again = np.isin(own, wanted)
                starts, doc = starts[again], doc[again]
                block = (least[again] >> np.uint64(64 - bits)).astype(np.int64)
                # A segment: windows of one document and block that follow each other.
                cut = _starts(block, doc, starts - np.arange(len(starts)))
                dids, ths = _numpy(part, "did"), _numpy(part, "th")
                segments = np.empty(len(cut), _SEGMENT)
                segments["d"], segments["t"], segments["s"] = dids[doc[cut]], ths[doc[cut]], starts[cut] - offsets[doc[cut]]
                segments["n"] = np.diff(np.append(cut, len(starts)))
                owners, block = doc[cut], block[cut]
                pieces = [texts[o][s : s + n + window - 1] for o, s, n in zip(owners.tolist(), segments["s"].tolist(), segments["n"].tolist(), strict=True)]
                of, factors, *windows = _parse(segments, _numbered([w for p in pieces for w in p]), window)
                did, th, hits = _by_document(segments["d"][of], segments["t"][of], factors)
                seg, first, n = _new_runs(segments, *windows)
                rest = segments[seg]
                rest["s"] += first.astype(np.int32)
                rest["n"] = n
                words = [b" ".join(pieces[o][f : f + k + window - 1]) for o, f, k in zip(seg.tolist(), first.tolist(), n.tolist(), strict=True)]
                spread = (did.to_numpy() ^ (did.to_numpy() >> 17) ^ th.to_numpy()) & (2**bits - 1)
                # Which part of its blocks a slice's segments go to hangs on its documents alone.
                share = int(np.bitwise_xor.reduce(ths)) % parts if len(ths) else 0
                yield _packed(block[seg], share, rest, words, did, th, hits, spread)

    return candidates.mapInArrow(run, "block long, part int, segments binary, words binary, did long, th long, hits binary")


def _blockwise(lookups: DataFrame, window: int, by: tuple[str, ...], last: bool) -> DataFrame:
    """Segments parsed block by block: ``did, th, hits``; unless ``last``, what is new goes on, in the same form."""

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        table = table.combine_chunks()
        settled = table.filter(pa.compute.is_valid(table["hits"]))
        packed = [x for x in table["segments"].to_pylist() if x]
        segments = np.frombuffer(b"".join(packed), _SEGMENT)
        words = b" ".join(x for x in table["words"].to_pylist() if x is not None).split(b" ") if packed else []
        of, factors, owner, within, new = _parse(segments, _numbered(words), window)
        did, th, hits = _by_document(segments["d"][of], segments["t"][of], factors)
        if last:
            own = pa.table({"did": did, "th": th, "hits": hits})
            return pa.concat_tables([own, settled.select(["did", "th", "hits"]).cast(own.schema)])
        seg, first, n = _new_runs(segments, owner, within, new)
        rest = segments[seg]
        begins = np.cumsum(segments["n"].astype(np.int64) + window - 1) - (segments["n"] + window - 1)
        begin = begins[seg] + first
        rest["s"] += first.astype(np.int32)
        rest["n"] = n
        pieces = [b" ".join(words[b : b + k + window - 1]) for b, k in zip(begin.tolist(), n.tolist(), strict=True)]
        block = table["block"][0].as_py()
        out = _packed(np.full(len(rest), block), 0, rest, pieces, did, th, hits, np.full(len(did), block))
        return pa.concat_tables([pa.Table.from_batches([out]), settled.cast(_LOOKUPS)])

    schema = "did long, th long, hits binary"
    return lookups.groupBy(*by).applyInArrow(run, schema if last else f"block long, part int, segments binary, words binary, {schema}")


def _parsed(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``did, th, text, found`` of every row: packed factors, of this document or one with the same dk."""
    size = _text_bytes(docs)
    bits, parts = _block_bits(size), min(MOST_PARTS, 1 << (size // PART_BYTES).bit_length())
    keyed = _keyed(docs)
    known = _repeated_anchors(_anchor_places(keyed, bits, window, gram)).groupBy("dk").agg(F.collect_list("mark").alias("known"))
    # Whole texts are shuffled once, to tasks of bounded size; that exchange is planned once and reused by the last join below.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    keyed = keyed.repartition(tasks, "dk")
    met = keyed.join(known, "dk").select("did", "th", "known", "text")
    lookups = _segments(met, bits, parts, window, gram)
    if parts > 1:
        lookups = _blockwise(lookups, window, ("block", "part"), False)
    hits = _blockwise(lookups, window, ("block",), True)
    key = F.xxhash64("did", "th").bitwiseAND(F.lit(2**KEY_BITS - 1)).alias("dk")
    hits = hits.groupBy(key).agg(F.collect_list(F.struct("did", "th", "hits")).alias("found"))
    return keyed.join(hits, "dk", "left").select("did", "th", "text", "found")


def _of_document(found, did: int, th: int):
    """The factors of a document among those of its join key, by first word."""
    import numpy as np

    own = np.frombuffer(b"".join(f["hits"] for f in found or () if f["did"] == did and f["th"] == th), _FACTOR)
    return own[np.argsort(own["s"], kind="stable")]


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, start, length, source_id, source_start``: the factors of every document, in words.

    Factors that meet at the edge of two blocks and copy on from one source are told as one. Null ids read as null
    again. A document without repeated windows, a null or an empty text has no factor; of repeated rows each has
    them. An empty table gives none. Which of several equal passages a factor copies is the first its block knows.
    """

    def run(batches):
        for batch in batches:
            out = []
            for did, th, found in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                own = []
                for s, n, d, a in _of_document(found, did, th).tolist():
                    if own and own[-1][3] == d and own[-1][4] - own[-1][1] == a - s and s <= own[-1][1] + own[-1][2]:
                        own[-1][2] = max(own[-1][2], s + n - own[-1][1])
                    else:
                        own.append([did, s, n, d, a])
                out += own
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "length", "source_id", "source_start"]
            )

    parsed = _parsed(docs, window, gram).select("did", "th", "found")
    out = parsed.mapInArrow(run, "doc_id long, start int, length int, source_id long, source_start int")
    back = lambda c: F.nullif(c, F.lit(_LAST_ID)).alias(c)
    return out.select(back("doc_id"), "start", "length", back("source_id"), "source_start")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for each row: the words outside all factors, joined by a space.

    A window of ``window`` words of one document is repeated if the same words start earlier: in a
    document of smaller id, or in the same one further ahead; factors cover exactly the repeated windows. Windows are
    judged on the input. Null and empty texts have no words. A null id comes after all others. Rows that share an id
    are the same document if their texts are equal, else ordered by a hash of the text. An empty table gives an empty
    result. Other columns are ignored.
    """

    def run(batches):
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, marks, texts, found = (batch.column(c).slice(at, 512) for c in range(4))
                n_words, n_removed, kept = [], [], []
                for did, th, text, own in zip(*(x.to_pylist() for x in (ids, marks, texts, found)), strict=True):
                    words = text.encode("utf-8", "surrogatepass").split()
                    own = _of_document(own, did, th)
                    n_words.append(len(words))
                    if len(own):
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, own["s"], 1)
                        np.add.at(edge, own["s"] + own["n"], -1)
                        stay = np.cumsum(edge[:-1]) == 0
                        words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    parsed = _parsed(docs, window, gram)
    out = parsed.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(_LAST_ID)))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
