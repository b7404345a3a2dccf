"""Token ids in packed matrices: best-fit-decreasing packing with a segment tree over free room.

Texts become ids of a byte-level vocabulary. A document longer than a row is split into full rows and
a rest, losing nothing. The pieces of a shard, longest first, go to the row with the least room that
still fits, which a segment tree over the rooms finds in logarithmic time. A shard is a binary file:
the id matrix, then per row the cumulative segment lengths, then per row the positions at which counting starts over: with
each segment, and with the fill. Ids take two bytes, or four where the vocabulary needs them.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import file_system, materialize, shared_path

ROW, VOCABULARY = 2048, "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's byte-level encoding cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens packed together: bounds a worker's memory, and leaves one ill-filled row in thousands.
SHARD_TOKENS = 8_000_000
#: Encoded words a worker remembers before it starts over.
REMEMBERED = 300_000
#: White space and the word after it; encoding never merges across such a cut.
_CHUNK = re.compile(r"[^\S\x1c-\x1f]*(?:\S|[\x1c-\x1f])+|[^\S\x1c-\x1f]+")


class Encoder(dict):
    """Token ids of a text, as little-endian bytes of ``kind``; remembers the words it has encoded.

    ``pad`` fills rows: the id after the vocabulary's last, which no text encodes to.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pad = max(ranks.values()) + 1
        self.kind = "<u2" if self.pad < 1 << 16 else "<u4"
        self.encoding = tiktoken.Encoding("packed", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, chunk: str) -> bytes:
        import numpy as np

        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.encoding.encode_ordinary(chunk)
        value = np.array(ids, self.kind).tobytes()
        if len(chunk) <= 64:
            self[chunk] = value
        return value

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, _CHUNK.findall(text or "")))


class RoomTree:
    """Counts of open rows by free room, as a segment tree: the least room that is large enough, quickly."""

    def __init__(self, most: int):
        self.leaves = 1 << max(1, most).bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.counts[at] += n
            at >>= 1

    def least(self, wanted: int) -> int:
        """The smallest room >= ``wanted`` that some row has, or -1."""
        at = wanted + self.leaves
        if self.counts[at]:
            return wanted
        while at > 1:
            if not at & 1 and self.counts[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.counts[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit(sizes: list[int], row: int) -> list[list[int]]:
    """Pieces (by number) of each row; sizes are 1 to ``row``. Equal sizes keep their order."""
    tree, rows, by_room = RoomTree(row), [], {}
    for n in sorted(range(len(sizes)), key=lambda n: (-sizes[n], n)):
        size = sizes[n]
        room = tree.least(size)
        if room < 0:
            rows.append([])
            at, room = len(rows) - 1, row
        else:
            at = by_room[room].pop()
            tree.add(room, -1)
        rows[at].append(n)
        if room > size:
            by_room.setdefault(room - size, []).append(at)
            tree.add(room - size, 1)
    return rows


def split(size: int, row: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; a document without tokens has none."""
    return [(at, min(row, size - at)) for at in range(0, size, row)]


def resets(ends, row: int) -> list[int]:
    """Where positions start over in a row: at each segment, and at the fill behind the last."""
    return [int(e) for e in ends if e < row]


def write_shard(folder: str, docs: list[tuple[object, bytes]], row: int, kind: str, pad: int, prefix: str) -> list[dict]:
    """Pack (doc_id, ids) into one file of ``folder`` and describe its rows.

    The file is named by the prefix and what it holds, and appears when it is whole.
    """
    import numpy as np

    width = np.dtype(kind).itemsize
    pieces = [(n, start, length) for n, (_, ids) in enumerate(docs) for start, length in split(len(ids) // width, row)]
    rows = best_fit([length for *_, length in pieces], row)
    matrix = np.full((len(rows), row), pad, kind)
    described = []
    for r, members in enumerate(rows):
        at, ends = 0, [0]
        for m in members:
            n, start, length = pieces[m]
            matrix[r, at : at + length] = np.frombuffer(docs[n][1], kind, length, width * start)
            at += length
            ends.append(at)
        described.append(
            {"row": r, "n_tokens": at, "doc_ids": [docs[pieces[m][0]][0] for m in members],
             "doc_starts": [pieces[m][1] for m in members], "cu_seqlens": ends, "position_resets": resets(ends, row)}
        )
    head = json.dumps({"rows": len(rows), "row": row, "ids": kind}).encode().ljust(128)
    parts = [head, matrix.tobytes()]
    for name in ("cu_seqlens", "position_resets"):
        lists = [d[name] for d in described]
        parts += [np.array([len(x) for x in lists], "<i4").tobytes(), np.array([v for x in lists for v in x], "<i4").tobytes()]
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    name = f"{prefix}-{digest.hexdigest()[:24]}.bin"
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    draft = f"{path}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    fs.move(draft, f"{path}/{name}")
    return [{"shard": name, **d} for d in described]


def read_shard(folder: str, name: str):
    """(id matrix, list of cumulative segment lengths, position matrix) of a shard."""
    import numpy as np

    fs, path = file_system(folder)
    with fs.open_input_file(f"{path}/{name}") as file:
        data = file.read()
    head = json.loads(data[:128])
    n, row, at = head["rows"], head["row"], 128
    matrix = np.frombuffer(data, head["ids"], n * row, at).reshape(n, row)
    at += matrix.nbytes
    lists = []
    for _ in range(2):
        counts = np.frombuffer(data, "<i4", n, at)
        lists.append(np.split(np.frombuffer(data, "<i4", int(counts.sum()), at + 4 * n), np.cumsum(counts)[:-1]) if n else [])
        at += 4 * (n + int(counts.sum()))
    ends, starts = lists
    return matrix, ends, np.stack([positions(s, row) for s in starts]) if n else np.empty((0, row), np.int32)


def positions(starts, row: int):
    """Positions of a row, which start over at each of ``starts``."""
    import numpy as np

    since = np.zeros(row, np.int32)
    since[starts] = starts
    return np.arange(row, dtype=np.int32) - np.maximum.accumulate(since)


def pack(docs: DataFrame, row: int = ROW, vocabulary: str = VOCABULARY) -> tuple[str, DataFrame]:
    """Write the packed shards of ``docs`` and return (their folder, a row per packed row).

    ``shard, row, n_tokens, doc_ids, doc_starts, cu_seqlens, position_resets``: the segments of a row in order, with the
    document of each and its first token there. Shards are packed where the documents are, without
    moving texts, and named by what they hold; the folder is in shared storage. An attempt that fails leaves at most a
    file that no row names. Null and empty texts have no tokens and no segment. Repeated rows are packed each, null ids
    too. Pieces of equal length keep the table's order. An empty table makes no shard. Only doc_id and text are read.
    ``vocabulary`` is a path on every executor; ship the file with the job.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "packed")
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"shard string, row int, n_tokens int, doc_ids array<{kind}>, doc_starts array<int>, cu_seqlens array<int>, position_resets array<int>"

    def run(batches):
        from pyspark import TaskContext

        encoder, waiting, size = Encoder(vocabulary), [], 0
        arrow, width, written = None, 2 if encoder.kind == "<u2" else 4, 0

        def flush():
            table = write_shard(folder, waiting, row, encoder.kind, encoder.pad, f"{TaskContext.get().partitionId():05d}-{written:04d}")
            ints = pa.list_(pa.int32())
            types = {
                "shard": pa.string(), "row": pa.int32(), "n_tokens": pa.int32(), "doc_ids": pa.list_(arrow), "doc_starts": ints,
                "cu_seqlens": ints, "position_resets": ints,
            }
            return pa.RecordBatch.from_arrays([pa.array([d[c] for d in table], t) for c, t in types.items()], names=list(types))

        for batch in batches:
            arrow = batch.column(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    waiting.append((doc_id, encoder.encode(text)))
                    size += len(waiting[-1][1]) // width
                if size >= SHARD_TOKENS:
                    yield flush()
                    waiting, size, written = [], 0, written + 1
        if waiting:
            yield flush()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return folder, materialize(rows, "packed-rows")


def checked(folder: str, rows: DataFrame) -> DataFrame:
    """``rows`` with ``ids_sha256``, of each row's ids as they stand in its file: all of them, fill included.

    A repeated row gets the same digest again, an empty table stays empty; a row that names no file of the folder is an error.
    """

    def run(batches):
        shards: dict = {}
        for batch in batches:
            digests = []
            for name, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name not in shards:
                    shards = {name: read_ids(folder, name)}
                digests.append(hashlib.sha256(shards[name][r].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=[*batch.schema.names, "ids_sha256"])

    return rows.mapInArrow(run, rows.withColumn("ids_sha256", F.lit("")).schema)


def read_ids(folder: str, name: str):
    """The id matrix of a shard."""
    import numpy as np

    fs, path = file_system(folder)
    with fs.open_input_file(f"{path}/{name}") as file:
        head = json.loads(file.read(128))
        size = np.dtype(head["ids"]).itemsize * head["rows"] * head["row"]
        return np.frombuffer(file.read(size), head["ids"]).reshape(head["rows"], head["row"])
