"""WARC archives with a two-level capture index.

Records are gzip members of WARC files, so each can be read by its range alone. The index has a line
per capture, sorted by reversed-host key, in compressed blocks; a sparse directory keeps each block's
first key and range. A look-up searches the directory of its index part in halves, reads one block,
and then the record's range.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import fill, file_system, materialize, shared_path

#: Captures in a compressed index block; bytes of records per archive file; bytes read at once over adjacent records.
BLOCK_LINES, ARCHIVE_BYTES, READ_BYTES = 3000, 256_000_000, 4_000_000
#: Smallest payload that may be stored as a revisit of an equal one.
LEAST_PAYLOAD = 0
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


@dataclass(frozen=True)
class Archive:
    """Where an archive and its index are, and the index's parts: (first key, file) in order."""

    folder: str
    parts: list[tuple[str, str]]


def reversed_host_key(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then port, path and query; without scheme, www and fragment.

    Null is the empty key; what has no host is its own key, in lower case.
    """
    if url is None:
        return ""
    found = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\d*\.)?([^/?#:]*)(:\d+)?([^#]*)", url.strip(), re.I)
    if not found or not found[1]:
        return url.strip().lower()
    host = ",".join(reversed([label for label in found[1].lower().split(".") if label]))
    return f"{host}{found[2] or ''}){found[3] or '/'}"


def sort_key(url: str | None, page_id: int) -> str:
    """The key with the page's id behind it, so that captures of one URL have an order and a range can split them."""
    key = re.sub(r"[\x00-\x1f]", lambda c: f"%{ord(c[0]):02X}", reversed_host_key(url))
    return f"{key}\t{page_id + 2**63:020d}" if page_id is not None else key + "\t"



def _record(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, refers: int | None) -> bytes:
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    target = quote(url, safe="%/:?#[]@!$&'()*+,;=~-._") if url else f"urn:page:{page_id}"
    body = _HTTP + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(refers)}", f"WARC-Refers-To-Page-ID: {refers}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and payload of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def _roles(pages: DataFrame, least: int) -> DataFrame:
    """``pages`` as page_id, url, html, digest, refers_to: the first page of equal payload, where that is another."""
    html = fill(F.col("html"))
    known = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.sha1(F.encode(html, "UTF-8")).alias("sha1"),
    )
    marked = known.where(F.octet_length("html") >= least).select("page_id", "sha1")
    firsts = marked.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = (
        marked.distinct().join(firsts, "sha1").where(F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first")))
        .select(F.col("page_id").alias("_page"), F.col("sha1").alias("_sha1"), F.col("first").alias("refers_to"))
    )
    both = known.join(later, (F.col("page_id") == F.col("_page")) & (F.col("sha1") == F.col("_sha1")), "left")
    return both.select("page_id", "url", "html", "sha1", "refers_to")


def write_archive(pages: DataFrame, least_payload: int = LEAST_PAYLOAD) -> Archive:
    """Write a record per row of ``pages`` (page_id, url, html) to the shared folder, and its index.

    Null html is an empty payload; a null url is archived under the page's id. Of equal payloads of at
    least ``least_payload`` bytes the one with the smallest page_id is a response, the others revisit
    it; rows that repeat that page are responses as well. A null page_id is a response. Other columns
    are ignored. An attempt that fails leaves files that no index line names.
    """
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    # Dealt by id, not by payload: a payload may be shared by a third of all pages.
    rows = _roles(pages, least_payload)

    def archive(batches):
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        out, name, size = None, "", 0
        for batch in batches:
            lines = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                for page_id, url, html, sha1, refers in zip(*(part[c] for c in ("page_id", "url", "html", "sha1", "refers_to")), strict=True):
                    if out is None or size >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    kind = "response" if refers is None else "revisit"
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    member = gzip.compress(_record(kind, page_id, url, digest, html.encode("utf-8", "surrogatepass"), refers), 5, mtime=0)
                    out.write(member)
                    lines.append((sort_key(url, page_id), name, size, len(member)))
                    size += len(member)
            cols = list(zip(*lines, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    # Written before it is sorted, so that a lost executor never leads to a second, different archive.
    lines = materialize(rows.mapInArrow(archive, "key string, file string, offset long, length long"), "warc-lines")

    def blocks(batches):
        """One index part: its blocks, and behind them its directory."""
        fs, path = file_system(folder)
        name, waiting, directory, size, out = f"{uuid.uuid4().hex}.cdx", [], [], 0, None

        def flush():
            nonlocal size, waiting
            block = zlib.compress("\n".join(waiting).encode("utf-8", "surrogatepass"), 6)
            directory.append((waiting[0].rsplit("\t", 3)[0], size, len(block)))
            out.write(block)
            size, waiting = size + len(block), []

        for batch in batches:
            for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
                waiting.append(f"{key}\t{file}\t{offset}\t{length}")
                if len(waiting) == BLOCK_LINES:
                    flush()
        if out is not None:
            if waiting:
                flush()
            book = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(book + size.to_bytes(8, "little") + len(book).to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name])], names=["first", "name"])

    ordered = lines.repartitionByRange("key").sortWithinPartitions("key", "file", "offset")
    # A row per index part: as many as the range sort has partitions, which the cluster's settings bound.
    parts = materialize(ordered.mapInArrow(blocks, "first string, name string"), "warc-parts").orderBy("first").collect()
    return Archive(folder, [(r["first"], r["name"]) for r in parts])


class Index:
    """Look-ups in an archive's index; keeps one part's directory and one block."""

    def __init__(self, archive: Archive):
        self.archive, (self.fs, self.path) = archive, file_system(archive.folder)
        self.firsts = [first for first, _ in archive.parts]
        self.part = self.block = None

    def _directory(self, name: str):
        if self.part is None or self.part[0] != name:
            with self.fs.open_input_file(f"{self.path}/{name}") as file:
                end = file.size()
                file.seek(end - 16)
                at, length = (int.from_bytes(file.read(8), "little") for _ in range(2))
                file.seek(at)
                directory = json.loads(zlib.decompress(file.read(length)))
            self.part = (name, [d[0] for d in directory], directory)
        return self.part

    def _lines(self, name: str, offset: int, length: int):
        if self.block is None or self.block[0] != (name, offset):
            with self.fs.open_input_file(f"{self.path}/{name}") as file:
                file.seek(offset)
                lines = zlib.decompress(file.read(length)).decode("utf-8", "surrogatepass").split("\n")
            cut = [line.rsplit("\t", 3) for line in lines]
            self.block = ((name, offset), [c[0] for c in cut], cut)
        return self.block

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """(file, offset, length) of every capture with this key; they may reach over blocks and parts."""
        found = []
        p = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while p < len(self.firsts) and self.firsts[p] <= key:
            name, keys, directory = self._directory(self.archive.parts[p][1])
            b = max(0, bisect.bisect_left(keys, key) - 1)
            while b < len(keys) and keys[b] <= key:
                _, own, cut = self._lines(name, directory[b][1], directory[b][2])
                at = bisect.bisect_left(own, key)
                while at < len(own) and own[at] == key:
                    found.append((cut[at][1], int(cut[at][2]), int(cut[at][3])))
                    at += 1
                b += 1
            p += 1
        return found


def look_up(archive: Archive, wanted: DataFrame) -> DataFrame:
    """``page_id, file, offset, length`` of the captures of each distinct (page_id, url) of ``wanted``."""

    def keyed(batches):
        for batch in batches:
            keys = [sort_key(u, i) for i, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string())], names=["page_id", "key"])

    def find(batches):
        index = Index(archive)
        for batch in batches:
            out = [(i, *hit) for i, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in index.find(key)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "file", "offset", "length"])

    pages = wanted.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    # In key order, so that neighbours share a directory and a block.
    keys = pages.mapInArrow(keyed, "page_id long, key string").distinct().repartitionByRange("key").sortWithinPartitions("key")
    return keys.mapInArrow(find, "page_id long, file string, offset long, length long")


def read_records(archive: Archive, places: DataFrame) -> DataFrame:
    """Records at (file, offset, length): ``page_id, record_type, payload_bytes, payload_digest, refers_to, intact``.

    Adjacent records are fetched together. payload_bytes is null for a revisit, whose payload is
    elsewhere; ``intact`` tells whether a response's payload has the digest of its header.
    """

    def run(batches):
        fs, path = file_system(archive.folder)
        name, file, start, data = None, None, 0, b""
        for batch in batches:
            out = []
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for n, (f, offset, length) in enumerate(rows):
                if f != name:
                    if file is not None:
                        file.close()
                    name, file, start, data = f, fs.open_input_file(f"{path}/{f}"), 0, b""
                if not start <= offset <= offset + length <= start + len(data):
                    end = offset + length
                    for g, o, m in rows[n + 1 :]:  # as far as records follow each other
                        if g != f or o != end or o + m - offset > READ_BYTES:
                            break
                        end = o + m
                    file.seek(offset)
                    start, data = offset, file.read(end - offset)
                fields, payload = parse_record(gzip.decompress(data[offset - start : offset - start + length]))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                response = fields["WARC-Type"] == "response"
                page, refers = fields["WARC-Page-ID"], fields.get("WARC-Refers-To-Page-ID")
                intact = not response or base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
                out.append((int(page) if page else None, fields["WARC-Type"], len(payload) if response else None, digest, int(refers) if refers else None, intact))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "intact"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        if file is not None:
            file.close()

    ordered = places.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean")


def report(pages: DataFrame, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """A row per page of what the archive holds of it, found through the index and read back.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. A revisit has the size of the
    response it refers to. Rows that repeat a page's id and url are as many records, each returned once.
    """
    archive = write_archive(pages, least_payload)
    records = materialize(read_records(archive, look_up(archive, pages)), "warc-records")
    sizes = records.where("record_type = 'response' and page_id is not null").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("_bytes"))
    sizes = sizes.withColumnsRenamed({"page_id": "_page", "payload_digest": "_digest"})
    # Responses that nothing refers to stay out of the join, so its right side has the shared payloads only.
    revisits = records.where("record_type = 'revisit'")
    shared = sizes.join(revisits.select("refers_to").distinct(), F.col("_page") == F.col("refers_to"), "left_semi")
    resolved = revisits.join(shared, (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    columns = ["page_id", "payload_digest", "record_type", "refers_to"]
    both = records.where("record_type = 'response'").select("payload_bytes", *columns).unionByName(resolved.select(F.col("_bytes").alias("payload_bytes"), *columns))
    return both.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
