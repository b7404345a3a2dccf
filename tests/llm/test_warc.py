import base64
import glob
import gzip
import hashlib

from likeness.llm import warc

PAGES = [
    (5, "http://www.a.example.com/x?q=1#f", "same"), (3, "https://a.example.com/x?q=1", "same"), (9, "http://b.example.com:80/", "same"),
    (1, None, None), (2, "", ""), (4, "no host é", "é𝒳\r\n\r\nWARC/1.1"), (6, "http://a.example.com/é b\nc", "x" * 200_000),
    (7, "http://a.example.com/x?q=1", "other"), (8, "http://a.example.com/x?q=1", None), (-7, "http://z.example/", "same"), (10, "http://Z.Example", "X"),
]


def expected(pages):
    data = {i: (h or "").encode() for i, _, h in pages}
    first = {}
    for i, d in data.items():
        first[d] = min(first.get(d, i), i)
    return sorted((i, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "response" if first[d] == i else "revisit", None if first[d] == i else first[d]) for i, d in data.items())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "f") for r in rows], "page_id long, url string, html string, file string")


def test_keys_reverse_the_host():
    assert warc.reversed_host_key("https://Blog.A.example.com:8080/p?q#f") == "com,example,a,blog:8080)/p?q"
    assert warc.reversed_host_key("http://www.x.org") == "org,x)/"
    assert warc.reversed_host_key(None) == "" and warc.reversed_host_key(" Mailto:x ") == "mailto:x"
    assert warc.sort_key("http://x.org", -1) < warc.sort_key("http://x.org", 0) < warc.sort_key("http://x.org", 10)


def test_reads_back_what_it_wrote(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    got = sorted(map(tuple, warc.report(frame(spark, PAGES)).collect()))
    assert got == expected(PAGES)


def test_repeated_and_null_ids(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (2, "u", "a"), (None, "u", "a"), (1, "v", "b")]
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in warc.report(frame(spark, rows)).collect())
    assert got == [(0, 1, "response", 0), (1, 1, "response", 0), (1, 1, "response", 0), (1, 1, "response", 0), (2, 1, "revisit", 1)]


def test_small_payloads_are_all_responses(spark):
    got = {r["page_id"]: r["record_type"] for r in warc.report(frame(spark, [(1, "u", "ab"), (2, "v", "ab"), (3, "w", "abc"), (4, "x", "abc")]), 3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_archives_are_warc_files_and_the_index_finds_each_capture(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    archive = warc.write_archive(frame(spark, PAGES))
    index, places = warc.Index(archive), {}
    for i, url, _ in PAGES:
        places[i], = index.find(warc.sort_key(url, i))
    assert index.find(warc.sort_key("http://a.example.com/none", 1)) == [] == index.find("zzz")
    folder = archive.folder.removeprefix("file://")
    records = b"".join(gzip.open(f).read() for f in sorted(glob.glob(f"{folder}/*.warc.gz")))
    assert records.count(b"WARC-Record-ID: ") == len(PAGES)
    for i, (file, offset, length) in places.items():
        with open(f"{folder}/{file}", "rb") as data:
            data.seek(offset)
            fields, payload = warc.parse_record(gzip.decompress(data.read(length)))
        assert fields["WARC-Page-ID"] == str(i) and (fields["WARC-Type"] == "revisit" or payload == (dict((p[0], p[2]) for p in PAGES)[i] or "").encode())


def test_empty_table(spark):
    assert warc.report(frame(spark, [])).count() == 0
