import base64
import hashlib

from tierlens.llm import warc
from tierlens.llm.tables import read
from tierlens.runtime import scratch_dir


def brute(rows):
    first = {}
    for i, html in rows:
        key = 2**63 if i is None else i
        first[html or ""] = min(key, first.get(html or "", 2**63))
    out = []
    for i, html in rows:
        raw = (html or "").encode()
        own = first[html or ""]
        again = own != (2**63 if i is None else i)
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", own if again else None))
    return sorted(out, key=str)


def test_table(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    want = brute([(r.page_id, r.html) for r in pages.collect()])
    assert sorted(map(tuple, warc.archive_pages(pages).collect()), key=str) == want


ROWS = [(1, "http://a/1", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://a/3\r\nWARC-Type: x", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\n"), (4, "u", None),
        (5, "u5", ""), (6, "u6", "\r\n\r\n"), (7, "u7", "🤦" * 5000), (8, "u8", "<p>é</p>"), (9, "u9", "a\nb\rc\x00\x0b"), (None, "n", "no id")]


def test_odd_pages(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id bigint, url string, html string, payload_digest string, first int").repartition(3)
    got = sorted(map(tuple, warc.archive_pages(df).collect()), key=str)
    assert got == brute([(i, h) for i, _, h in ROWS])


def test_payloads_survive_and_small_ones_are_all_responses(spark):
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").repartition(2)
    path = scratch_dir(spark, "warc-test")
    warc.write_archives(df, path, least_bytes=9)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert got[8].record_type == "revisit" and got[8].refers_to_id == got[1].record_id and got[8].payload is None
    assert got[4].record_type == got[5].record_type == "response"
    for i, _, html in ROWS:
        if got[i].record_type == "response":
            assert bytes(got[i].payload).decode() == (html or "")


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (2, "u", "x")], "page_id bigint, url string, html string")
    assert sorted(r.record_type for r in warc.archive_pages(df).collect()) == ["response", "response", "revisit"]
    assert warc.archive_pages(df.filter("false")).collect() == []


def test_long_payloads_fill_few_records_a_file(spark, monkeypatch):
    monkeypatch.setattr(warc, "SIZES", (10, 100))
    monkeypatch.setattr(warc, "FILE_BYTES", 300)
    rows = [(i, f"u{i}", "x" * n) for i, n in enumerate([5] * 40 + [50, 60, 70, 80, 90, 100, 101, 5000, 5000])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    path = scratch_dir(spark, "warc-sizes")
    assert sorted(map(tuple, warc.archive_pages(df, path).collect()), key=str) == brute([(i, h) for i, _, h in rows])
    files = [[len(r.payload or b"") for r in warc.read_archives(spark, f.path).collect()]
             for f in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path").collect()]
    assert sum(map(len, files)) == len(rows) and all(sum(f) <= 300 or len(f) == 1 for f in files)
