"""Near-duplicates by SimHash: a byte-position inverted index with count filtering.

A fingerprint is a row of bytes at fixed positions. Postings are keyed by a few positions and their
bytes; within a posting list the shared positional bytes of each pair are tallied, pairs that reach
the guaranteed minimum are retained, and those are verified by their differing bits.

Two settings share this machinery. ``near_duplicates`` links 64-bit fingerprints by up to four bits:
a bit spoils one byte only, so four of the eight bytes stay, and the 20 triples of positions used as keys meet
every four positions: no pair is missed. ``similar_documents`` looks for similarity of 0.8, which is
too loose for such a guarantee; it takes longer fingerprints and more keys, of which a pair at the
threshold shares one in 99.8 of 100 cases, and these only propose pairs: a link is one whose shingle
sets have that Jaccard similarity.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likeness.llm.common import materialize, picker, placed, slices
from likeness.llm.components import SMALL_ROWS, connected_components, hot_join

SEED = 42
#: A posting list longer than this is cut into chunks, and each pair of chunks is compared in a task of its own.
CHUNK = 2048
#: Lists up to this length are compared all at once, longer ones one by one.
SHORT = 48
#: Proposals that join more confirmed groups than this make it worth a look which shingles their sets share.
CROWD = 16
#: Sets of fewer shingles are too small for their fingerprints to tell how similar they are.
FEW_SHINGLES = 32
#: Of the nodes that lists propose for a node, so many are compared with it at once.
LIKELIEST = 2
#: The most frequent shingles of such a place, of which each set's are marked.
MARKED = 512


def covering_triples() -> list[tuple[int, ...]]:
    """20 triples of the positions 0..7 of which every four positions contain one.

    The positions fall into three groups in a ring; the triples lie in one group, or have two positions
    in one group and one in the next.
    """
    group = [0, 0, 0, 1, 1, 1, 2, 2]

    def taken(triple) -> bool:
        kinds = sorted(group[i] for i in triple)
        if len(set(kinds)) == 3:
            return False
        twice = max(set(kinds), key=kinds.count)
        return len(set(kinds)) == 1 or (twice + 1) % 3 in kinds

    return [t for t in combinations(range(8), 3) if taken(t)]


def spread_pairs(octets: int, n: int) -> list[tuple[int, ...]]:
    """``n`` pairs of positions, each pass over all positions at a greater distance."""
    return [tuple(sorted((i, (i + step) % octets))) for step in range(1, octets, 2) for i in range(0, octets, 2)][:n]


@dataclass(frozen=True)
class Scheme:
    """How texts become fingerprints and fingerprints become postings."""

    shingle: int
    words64: int
    max_bits: int
    keys: tuple[tuple[int, ...], ...]
    #: Whether a shingle that a text repeats votes once instead of as often as it occurs.
    distinct: bool = False
    #: 64-bit words that a posting carries, to which max_bits refers; 0 for all.
    part64: int = 0

    @property
    def carried64(self) -> int:
        return self.part64 or self.words64

    @property
    def told(self) -> tuple[int, ...]:
        """The kinds of keys that the carried words tell, where these are a part of the fingerprint."""
        return tuple(n for n, places in enumerate(self.keys) if max(places) < 8 * self.part64)

    @property
    def least_shared(self) -> int:
        """Positional bytes that linked fingerprints share at least, those of one key if nothing more is guaranteed."""
        return max(0 if self.part64 else len(self.keys[0]), 8 * self.carried64 - self.max_bits)


#: Four-word shingles, 64 bits, up to four of them different.
CONTRACT = Scheme(4, 1, 4, tuple(covering_triples()))


def similarity_scheme(similarity: float = 0.8, shingle: int = 5, words64: int = 8, keys: int = 128, part64: int = 2, distinct: bool = False) -> Scheme:
    """Bits that differ at a Jaccard similarity of equally large shingle sets, by the angle between them.

    Pairs at the threshold differ in so many of the carried bits give or take a standard error; four errors more are let
    through, as what is proposed is compared exactly. One pair in 10,000 at the threshold differs in more.
    """
    share, bits = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * part64
    most = round(bits * share + 4 * math.sqrt(bits * share * (1 - share)))
    return Scheme(shingle, words64, most, tuple(spread_pairs(8 * words64, keys)), distinct, part64)


#: Upper to lower case for A-Z only, as bytes.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _bit_counts(hashes):
    """How often each bit is set, over rows of unsigned 64-bit numbers; the first bit is the highest.

    Long inputs are first added up three rows to two, bit by bit: a sum row and a row of carries.
    """
    import numpy as np

    counts, weight = np.zeros(64 * hashes.shape[1], np.int64), 1
    while len(hashes):
        carries = []
        while len(hashes) > 96:
            n = len(hashes) // 3
            a, b, c = hashes[:n], hashes[n : 2 * n], hashes[2 * n : 3 * n]
            either = a ^ b
            carries.append((a & b) | (c & either))
            hashes = np.concatenate([either ^ c, hashes[3 * n :]])
        octets = hashes.astype(">u8").view(np.uint8).reshape(len(hashes), -1)
        counts += weight * np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.uint16)
        hashes, weight = np.concatenate(carries) if carries else hashes[:0], 2 * weight
    return counts


def _shingles(text: str | None, scheme: Scheme):
    """XXH64 of the shingles of a text, in their order or, where each votes once, sorted; none for a text without words."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hash_of, shingle = xxhash.xxh64_intdigest, scheme.shingle
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([hash_of(line, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        begins, n = ends - sizes, len(words) - shingle + 1
        cut = zip(begins[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = np.fromiter((hash_of(line[a:b], SEED) for a, b in cut), np.uint64, n)
    return np.unique(hashes) if scheme.distinct else hashes


def _majority(hashes, scheme: Scheme) -> bytes:
    """The fingerprint of shingles.

    The first 64 bits stem from the shingles' XXH64 itself, further ones from numbers mixed from it.
    """
    import numpy as np

    lanes = [hashes]
    for lane in range(1, scheme.words64):
        x = (hashes ^ np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        lanes.append(x ^ (x >> np.uint64(32)))
    return np.packbits(2 * _bit_counts(np.stack(lanes, axis=1)) > len(hashes)).tobytes()


def fingerprint(text: str | None, scheme: Scheme = CONTRACT) -> bytes:
    """The fingerprint of a text, highest byte first; all zero for a text without words."""
    return _majority(_shingles(text, scheme), scheme)


def fingerprints(docs: DataFrame, scheme: Scheme = CONTRACT) -> DataFrame:
    """``doc_id, fp`` of each row of ``docs``."""
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("_text"))
    schema = docs.select("doc_id", F.lit(b"").alias("fp")).schema

    def run(batches):
        for batch in batches:
            for part, (texts,) in slices(batch, ["_text"]):
                fps = pa.array([fingerprint(t, scheme) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), fps], names=["doc_id", "fp"])

    return chosen.mapInArrow(run, schema)


def _numbers(column: pa.Array, words64: int):
    """Binary fingerprints as rows of unsigned 64-bit numbers."""
    import numpy as np

    flat = pa.array(column, column.type) if not isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(flat.to_pylist()), np.uint64).reshape(-1, words64)


def _near(x, y, scheme: Scheme):
    """Which rows of ``x`` and ``y`` share enough positional bytes and differ in few enough bits."""
    import numpy as np

    xor = np.ascontiguousarray(x ^ y)
    kept = np.arange(len(xor))
    if scheme.least_shared:
        tally = (xor.view(np.uint8).reshape(len(xor), -1) == 0).sum(axis=1)
        kept = np.nonzero(tally >= scheme.least_shared)[0]
    return kept[np.bitwise_count(xor[kept]).sum(axis=1, dtype=np.int64) <= scheme.max_bits]


def _first_met(x, y, kinds, scheme: Scheme):
    """Which pairs of rows of ``x`` and ``y``, met under these kinds of keys, have no earlier key in common that the carried words tell.

    What they tell comes before all else. A pair with an earlier key meets in that list too, so a pair is left to one list of
    those told, and forests of lists without such pairs join what whole ones join.
    """
    import numpy as np

    kept = np.ones(len(kinds), bool)
    for at in range(0, len(kinds), 1 << 16):
        part = slice(at, at + (1 << 16))
        same = np.ascontiguousarray(x[part] ^ y[part]).view(np.uint8).reshape(len(kinds[part]), -1) == 0
        for n in scheme.told:
            earlier = (kinds[part] > n) | ~np.isin(kinds[part], scheme.told)
            kept[part] &= ~(earlier & same[:, list(scheme.keys[n])].all(axis=1))
    return kept


def _may_agree(sizes, marks, others, x, y, similarity: float):
    """Which pairs of sets may have that Jaccard similarity.

    Two sets share the marked members that both have, and of the others, those aside that no other set has, at
    most as many as the one with fewer.
    """
    import numpy as np

    common = np.bitwise_count(marks[x] & marks[y]).sum(axis=1, dtype=np.int64) + np.minimum(others[x], others[y])
    return common >= similarity * (sizes[x] + sizes[y] - common) - 1e-9


def _forest(pairs):
    """Those of the pairs, in order, that join two trees. What a pair has besides its two ends stays with it."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (up := parent.get(i, i)) != i:
            parent[i] = parent.get(up, up)
            i = up
        return i

    kept = []
    for pair in pairs:
        a, b = root(pair[0]), root(pair[1])
        if a != b:
            parent[a] = b
            kept.append(pair)
    return kept


def _short_lists(prints, offsets, scheme: Scheme, may=None):
    """Links within many short lists at once: members at distance 1, 2, ... of all lists.

    A spanning forest, or with ``may`` all links between members of which it says that they may have one.
    """
    import numpy as np

    sizes, pairs = np.diff(offsets), []
    ends = np.repeat(offsets[1:], sizes)
    at = np.arange(offsets[0], offsets[-1])
    for gap in range(1, int(sizes.max(initial=1))):
        at = at[at + gap < ends[at - offsets[0]]]
        for lo in range(0, len(at), 1 << 16):
            i = at[lo : lo + (1 << 16)]
            i = i if may is None else i[may(i, i + gap)]
            near = i[_near(prints[i], prints[i + gap], scheme)]
            pairs += zip(near.tolist(), (near + gap).tolist(), strict=True)
    # A forest of stars around the first members, which are the same in many lists.
    return _forest(sorted(pairs)) if may is None else pairs


def _apart(prints, left, right, scheme: Scheme, may):
    """All links between two rows of members, or within one, that may be."""
    import numpy as np

    edges = []
    for n, i in enumerate(left.tolist()):
        other = left[n + 1 :] if right is None else right
        other = other[may(np.full(len(other), i), other)]
        edges += [(i, j) for j in other[_near(prints[other], prints[i : i + 1], scheme)].tolist()]
    return edges


def _long_list(left, right, scheme: Scheme):
    """Links of two rows of fingerprints, or of one with itself: a spanning forest, found breadth-first."""
    import numpy as np

    same = right is None
    both = left if same else np.concatenate([left, right])
    n, split = len(both), 0 if same else len(left)
    new, edges = np.ones(n, bool), []
    for start in range(n):
        if not new[start]:
            continue
        new[start] = False
        queue = [start]
        while queue:
            i = queue.pop()
            other = np.nonzero(new)[0] if same else np.nonzero(new[split:])[0] + split if i < split else np.nonzero(new[:split])[0]
            if not len(other):
                continue
            met = other[_near(both[other], both[i : i + 1], scheme)]
            new[met] = False
            queue += met.tolist()
            edges += [(i, int(j)) for j in met]
    return edges


def _long_lists(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """``key, n`` of the posting lists longer than CHUNK.

    A list is no longer than all lists of its kind of key together that have its first byte. These are counted first, and
    only keys under long ones are counted whole. There are 256 such counts a kind of key at most, whatever the input.
    """
    keys = [F.concat(F.lit(bytes([n])), *[F.substring("fp", p + 1, 1) for p in places]) for n, places in enumerate(scheme.keys)]
    narrow = nodes.select(F.explode(F.array(*keys)).alias("k"))
    shared = F.substring("k", 1, 2).alias("shared")
    wide = narrow.groupBy(shared).agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("shared")
    counts = narrow.select("k", shared).join(F.broadcast(wide), "shared", "left_semi").groupBy("k").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > CHUNK).select(F.conv(F.hex("k"), 16, 10).cast("long").alias("key"), "n")


def links(nodes: DataFrame, scheme: Scheme, apart: float = 0.0) -> DataFrame:
    """Edges ``a, b, bits`` between nodes (node long, fp binary) that join whatever the links of the scheme join.

    Each posting list yields a spanning forest of its links, so the edges grow with the lists and
    not with their squares, and components are those of all links. Edges are left out that an earlier list joins, as far as the
    carried words tell. ``bits`` is how many carried bits differ. With ``apart``, a similarity, the nodes have a
    ``root`` (long), and of their sets ``size`` and ``others`` (int) and ``marks`` (binary), and each list yields all its links
    between different roots instead whose sets may be that similar.
    """
    more = ["root", "size", "others", "marks"] if apart else []
    nodes = nodes.select("node", "fp", *more)

    def post(batches):
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                octets = _numbers(part.column(1), scheme.words64).view(np.uint8).reshape(part.num_rows, -1)
                keys = np.empty((part.num_rows, len(scheme.keys)), np.int64)
                for n, places in enumerate(scheme.keys):
                    keys[:, n] = n
                    for p in places:
                        keys[:, n] = (keys[:, n] << 8) | octets[:, p]
                own = pa.array(np.repeat(np.arange(part.num_rows), len(scheme.keys)))
                carried = pa.array([fp[: 8 * scheme.carried64] for fp in part.column(1).to_pylist()], pa.binary())
                columns = [part.column(0), carried, *part.columns[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *[c.take(own) for c in columns]], names=names)

    names = ["key", "node", "fp", *more]
    postings = nodes.mapInArrow(post, "key long, node long, fp binary" + (", root long, size int, others int, marks binary" if apart else ""))
    long_lists = materialize(_long_lists(nodes, scheme), "simhash-long")
    # Postings stay where they are if the long lists are counted few, and are dealt by key for the look-up otherwise.
    met = postings.join(F.broadcast(long_lists) if long_lists.count() <= SMALL_ROWS else long_lists, "key", "left")
    chunks = F.coalesce(F.ceil(F.col("n") / CHUNK).cast("int"), F.lit(1))
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    # A long list: its chunk meets every other chunk; the pair (x, y) of chunks with x <= y is one task's work.
    met = met.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), chunks - 1))})
    met = met.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", *names[1:])
    # Pairs of chunks are dealt on their own, however the long lists were joined.
    met = met.repartition("key", "x", "y")
    lists = met.groupBy("key", "x", "y").agg(
        F.collect_list(F.struct("own", *names[1:])).alias("members"), *([(F.min("root") < F.max("root")).alias("several")] if apart else [])
    ).where(F.size("members") > 1)
    lists = lists.where("several").drop("several") if apart else lists

    def run(batches):
        import numpy as np

        for batch in batches:
            x, y, members = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            flat = members.flatten()
            own, node, prints = (flat.field(0).to_numpy(), flat.field(1).to_numpy(), _numbers(flat.field(2), scheme.carried64))
            roots, sizes_of, others = (flat.field(n).to_numpy() for n in (3, 4, 5)) if apart else (None, None, None)
            marks = _numbers(flat.field(6), MARKED // 64) if apart else None
            may = (lambda a, b: (roots[a] != roots[b]) & _may_agree(sizes_of, marks, others, a, b, apart)) if apart else None  # noqa: B023
            offsets = members.offsets.to_numpy().astype(np.int64) - members.offsets[0].as_py()
            sizes = np.diff(offsets)
            # Members in order of nodes, so that lists with the same members propose the same pairs.
            of = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((node, of))
            own, node, prints = own[order], node[order], prints[order]
            if apart:
                roots, sizes_of, others, marks = roots[order], sizes_of[order], others[order], marks[order]
            edges = []
            short = (x == y) & (sizes <= SHORT)
            if short.any():
                kept = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in np.nonzero(short)[0]])
                starts = np.append(0, np.cumsum(sizes[short]))
                among = (lambda a, b: may(kept[a], kept[b])) if apart else None  # noqa: B023
                edges += [(kept[i], kept[j]) for i, j in _short_lists(prints[kept], starts, scheme, among)]
            for i in np.nonzero(~short)[0].tolist():
                at = np.arange(offsets[i], offsets[i + 1])
                if apart:
                    left, right = at[own[at] == x[i]], None if x[i] == y[i] else at[own[at] == y[i]]
                    edges += _apart(prints, left, right, scheme, may)
                elif x[i] == y[i]:
                    edges += [(at[a], at[b]) for a, b in _long_list(prints[at], None, scheme)]
                else:
                    at = np.concatenate([at[own[at] == x[i]], at[own[at] == y[i]]])
                    n = int((own[at] == x[i]).sum())
                    edges += [(at[a], at[b]) for a, b in _long_list(prints[at[:n]], prints[at[n:]], scheme)]
            a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
            if scheme.told:
                kinds = batch.column(0).to_numpy()[of[a]] >> 8 * len(scheme.keys[0])
                kept = _first_met(prints[a], prints[b], kinds, scheme)
                a, b = a[kept], b[kept]
            bits = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int32)
            a, b = node[a], node[b]
            if scheme.told and not apart:
                # Of what these lists propose, a forest of the likeliest pairs joins the same.
                best = np.lexsort((b, a, bits))
                forest = _forest(zip(a[best].tolist(), b[best].tolist(), bits[best].tolist(), strict=True))
                a, b, bits = (np.array([e[k] for e in forest], t) for k, t in enumerate((np.int64, np.int64, np.int32)))
            elif apart:
                best = np.lexsort((b, a))
                best = best[(np.diff(a[best], prepend=-1) != 0) | (np.diff(b[best], prepend=-1) != 0) | (np.arange(len(a)) == 0)]
                a, b, bits = a[best], b[best], bits[best]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(bits)], names=["a", "b", "bits"])

    return lists.mapInArrow(run, "a long, b long, bits int")


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component_id, n`` of each of ``nodes`` (node, doc_id, n): the smallest doc_id that the edges reach."""
    linked = materialize(nodes.join(connected_components(edges), "node").select("node", "doc_id", "root"), "simhash-linked")
    groups = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    found = hot_join(linked, groups, "root", linked.count()).select("node", "component_id")
    return nodes.join(found, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"), "n")


def _grouped(docs: DataFrame, scheme: Scheme) -> DataFrame:
    # A 64-bit fingerprint is its own number.
    prints = materialize(fingerprints(docs, scheme).withColumn("node", F.conv(F.hex("fp"), 16, -10).cast("long")), "simhash")
    nodes = materialize(prints.groupBy("node", "fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "simhash-nodes")
    by_node = materialize(_components(nodes, links(nodes, scheme)), "simhash-components")
    return hot_join(prints, by_node, "node", prints.count()).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` for each row: the smallest doc_id that links reach from it.

    Texts without words (null, empty) have fingerprint 0 and link like any other. Repeated rows are
    repeated in the result. A null doc_id takes part but names no component; where it is alone,
    component_id is null. Empty tables give empty results; columns besides doc_id and text are ignored.
    """
    return _grouped(docs, CONTRACT)


def _described(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """``doc_id, fp, node, _at``: node is a hash of the set of shingles."""
    schema = rows.select("doc_id", F.lit(b"").alias("fp"), F.lit(0).cast("long").alias("node"), "_at").schema

    def run(batches):
        import numpy as np
        import xxhash

        for batch in batches:
            for part, (texts,) in slices(batch, ["_text"]):
                sets = [_shingles(t, scheme) for t in texts]
                fps = pa.array([_majority(x, scheme) for x in sets], pa.binary())
                node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), fps, pa.array(node), part.column(2)], names=["doc_id", "fp", "node", "_at"])

    return rows.select("doc_id", "_text", "_at").mapInArrow(run, schema)


def _sets(rows: DataFrame, chosen: DataFrame, scheme: Scheme) -> DataFrame:
    """``node, shingles`` of the chosen nodes (node, _at): their sorted shingles, eight bytes each. Texts stay where they are."""
    pick = picker(chosen.select("_at", "node"), "similar-chosen")

    def run(batches):
        for batch in pick(batches):
            for part, (texts,) in slices(batch, ["_text"]):
                sets = pa.array([_shingles(t, scheme).tobytes() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(2), sets], names=["node", "shingles"])

    return rows.select("_at", "_text").mapInArrow(run, "node long, shingles binary")


def _thinned(edges: DataFrame) -> DataFrame:
    """Pairs ``a, b`` (a < b) that join what ``edges`` (a, b, repeated) join, far fewer than these where many meet in many lists.

    Each node keeps the LIKELIEST smaller ones of fewest different ``bits``, or without that column those that most lists propose
    for it; all its smaller ones are joined to the smallest of them, and these pairs are the same for many nodes.
    """
    least, known = (F.min("bits"), ["bits"]) if "bits" in edges.columns else (-F.count("*"), [])
    counted = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *known).where("a <> b").groupBy("a", "b").agg(least.alias("n"))
    met = counted.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("n", "a"))).alias("of"), F.min("a").alias("least"))
    own = met.select(F.explode(F.slice("of", 1, LIKELIEST)["a"]).alias("a"), "b")
    among = met.where(F.size("of") > 1).select(F.col("least").alias("a"), F.explode(F.col("of")["a"]).alias("b")).where("a <> b")
    return own.unionByName(among).distinct()


def _agreed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets of shingles have that Jaccard similarity or more."""

    def run(batches):
        import numpy as np

        for batch in batches:
            kept = []
            for part, (x, y) in slices(batch, ["x", "y"]):
                for one, other in zip(x, y, strict=True):
                    sizes = len(one) // 8, len(other) // 8
                    if min(sizes) < similarity * max(sizes):
                        kept.append(False)
                        continue
                    both = len(np.intersect1d(np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64), assume_unique=True))
                    kept.append(both / (sum(sizes) - both) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    x, y = (sets.select(F.col("node").alias(n), F.col("shingles").alias(c)) for n, c in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _likely(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``a, b`` that sizes and whole fingerprints (``known``: node, fp, size) leave open.

    Sets of that similarity have such sizes. Of FEW_SHINGLES or more they differ in the bits that the angle gives, with five
    standard errors let through, so one pair in millions at the threshold is left out. Sets of fewer are left to the exact comparison.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi

    def run(batches):
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x, y = part.column(2).to_pylist(), part.column(3).to_pylist()
                bits = 8 * len(x[0])
                differ = np.bitwise_count(np.frombuffer(b"".join(x), np.uint64) ^ np.frombuffer(b"".join(y), np.uint64))
                most = bits * share + 5 * math.sqrt(bits * share * (1 - share))
                near = differ.reshape(len(x), -1).sum(axis=1, dtype=np.int64) <= most
                few = part.column(4).to_numpy() < FEW_SHINGLES
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(near | few))

    x, y = (known.select(F.col("node").alias(n), F.col("fp").alias(f), F.col("size").alias(c)) for n, f, c in (("a", "x", "m"), ("b", "y", "n")))
    open_pairs = pairs.join(x, "a").join(y, "b").where(F.least("m", "n") >= similarity * F.greatest("m", "n") - 1e-9)
    return open_pairs.select("a", "b", "x", "y", F.least("m", "n").alias("least")).mapInArrow(run, "a long, b long")


def _shares(sets: DataFrame) -> DataFrame:
    """``node, others, marks`` of sets (node, place, shingles).

    ``marks`` has a bit for each of the MARKED most frequent shingles of the place, set if the set has it; ``others`` counts
    the set's further shingles that another set of the place has as well.
    """

    def each(batches):
        import numpy as np

        for batch in batches:
            for part, (shingles,) in slices(batch, ["shingles"]):
                sizes = [len(x) // 8 for x in shingles]
                node, place = (np.repeat(part.column(n).to_numpy(), sizes) for n in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(place), pa.array(np.frombuffer(b"".join(shingles), np.int64))], names=["node", "place", "shingle"])

    rows = sets.select("node", "place", "shingles").mapInArrow(each, "node long, place long, shingle long")
    counts = materialize(rows.groupBy("place", "shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")), "similar-shares")
    own = counts.where("n = 1").groupBy("node").agg(F.count("*").cast("int").alias("own"))
    frequent = Window.partitionBy("place").orderBy(F.col("n").desc(), "shingle")
    top = counts.withColumn("nth", F.row_number().over(frequent)).where((F.col("nth") <= MARKED) & (F.col("n") > 1))
    top = top.groupBy("place").agg(F.array_sort(F.collect_list("shingle")).alias("top"))
    members = sets.groupBy("place").agg(F.count("*").alias("n"))
    # Places hold more than CROWD sets each, so there are few among few sets.
    known = hot_join(sets.join(own, "node", "left"), top.join(members, "place"), "place", CROWD * sets.count())

    def mark(batches):
        import numpy as np

        for batch in batches:
            for part, (shingles, tops, owns) in slices(batch, ["shingles", "top", "own"]):
                marks, others = [], []
                for own_set, frequent, n in zip(shingles, tops, owns, strict=True):
                    held = np.isin(np.array(frequent, np.int64), np.frombuffer(own_set, np.int64))
                    marks.append(np.packbits(np.append(held, np.zeros(MARKED - len(held), bool))).tobytes())
                    others.append(len(own_set) // 8 - int(held.sum()) - (n or 0))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(others, pa.int32()), pa.array(marks, pa.binary())], names=["node", "others", "marks"])

    return known.select("node", "shingles", "top", "own").mapInArrow(mark, "node long, others int, marks binary")


def _unsettled(inside: DataFrame, sets: DataFrame, proposed: DataFrame, linked: DataFrame) -> DataFrame:
    """``node, fp, root, size, others, marks`` of the nodes whose proposals join several confirmed groups.

    All else that fingerprints could propose lies between two groups that proposals join. Where these are many,
    ``others`` and ``marks`` tell what their sets share; elsewhere all shingles count as others.
    """
    roots = connected_components(linked).select("node", F.col("root").alias("_root"))
    rows = inside.join(roots, "node", "left").select("node", "fp", "size", F.coalesce("_root", "node").alias("root"))
    rows = materialize(rows, "similar-roots")
    a, b = (rows.select(F.col("node").alias(n), F.col("root").alias(r)) for n, r in (("a", "ra"), ("b", "rb")))
    across = proposed.join(linked, ["a", "b"], "left_anti").join(a, "a").join(b, "b")
    places = materialize(connected_components(across.select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "similar-places")
    groups = places.groupBy("root").agg(F.count("*").alias("groups")).withColumnRenamed("root", "place")
    places = places.select(F.col("node").alias("root"), F.col("root").alias("place")).join(groups, "place")
    counts = rows.groupBy("root").agg(F.count("*").alias("n")).join(places, "root")
    rows = materialize(hot_join(rows, counts, "root", rows.count()), "similar-open")
    crowded = materialize(sets.join(rows.where(F.col("groups") > CROWD).select("node", "place"), "node"), "similar-crowded")
    shares = rows.join(_shares(crowded), "node", "left")
    none = F.lit(bytes(MARKED // 8))
    return shares.select("node", "fp", "root", "size", F.coalesce("others", "size").alias("others"), F.coalesce("marks", none).alias("marks"))


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """As ``near_duplicates``, linking texts whose shingle sets have that Jaccard similarity or more.

    Fingerprints propose pairs, the sets decide. First each posting list proposes a spanning forest, and of all of them
    pairs are kept that join the same. Where the confirmed part leaves groups apart that proposals had joined, all pairs between these groups
    are proposed whose sets may be that similar, by what they share of the place's most frequent shingles and by the size of the rest.
    Texts are written to the shared folder once, and are not moved after that.
    """
    rows = placed(docs.select("doc_id", F.col("text").cast("string").alias("_text")), "similar-rows")
    return _similar(rows, similarity, shingle).select("doc_id", "fp", "component_id")


def _similar(rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``doc_id, fp, component_id, _at`` of placed rows (doc_id, _text, _at)."""
    scheme = similarity_scheme(similarity, shingle, distinct=True)
    known = materialize(_described(rows, scheme), "similar")
    nodes = materialize(known.groupBy("node", "fp").agg(F.min("doc_id").alias("doc_id"), F.min("_at").alias("_at"), F.count("*").alias("n")), "similar-nodes")
    ordered = lambda edges: edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    proposed = materialize(_thinned(links(nodes, scheme)), "similar-pairs")
    met = proposed.select(F.col("a").alias("node")).unionByName(proposed.select(F.col("b").alias("node"))).distinct()
    inside = materialize(nodes.join(met, "node").select("node", "fp", "_at"), "similar-met")
    sets = materialize(_sets(rows, inside.select("node", "_at"), scheme), "similar-sets")
    sizes = sets.select("node", (F.octet_length("shingles") / 8).cast("int").alias("size"))
    inside = materialize(inside.join(sizes, "node"), "similar-sizes")
    likely = materialize(_likely(proposed, inside, similarity), "similar-likely")
    linked = materialize(_agreed(likely, sets, similarity), "similar-links")
    apart = materialize(_unsettled(inside, sets, proposed, linked), "similar-apart")
    rest = materialize(ordered(links(apart, scheme, similarity)).join(proposed, ["a", "b"], "left_anti"), "similar-rest")
    likely = materialize(_likely(rest, inside, similarity), "similar-likely")
    linked = linked.unionByName(materialize(_agreed(likely, sets, similarity), "similar-more"))
    by_node = materialize(_components(nodes, linked), "similar-components")
    return hot_join(known, by_node, "node", known.count()).select("doc_id", "fp", "component_id", "_at")


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` without all but one document of each group of similar ones: the one of smallest id.

    Of repeated rows with that id one stays; rows without an id all stay.
    """
    # Columns may have any names, so they get plain ones on the way.
    plain = placed(docs.toDF(*[f"c{n}" for n in range(len(docs.columns))]), "similar-rows")
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    found = _similar(plain.select(doc_id.alias("doc_id"), text.cast("string").alias("_text"), "_at"), similarity, shingle)
    own = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min("_at").alias("_at"))
    pick = picker(own.select("_at").unionByName(found.where("doc_id is null").select("_at")), "similar-kept")
    return plain.mapInArrow(pick, plain.schema).drop("_at").toDF(*docs.columns)
