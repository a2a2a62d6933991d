import base64
import hashlib

from pyspark.sql import functions as F
from termloom.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "'x' as first", "'x' as bytes", "'x' as value").repartition(2)


ROWS = [
    (1, "http://a.example.com/x", "<p>one</p>"), (2, "http://a.example.com/y?q=1", "<p>one</p>"), (3, None, None), (4, "", ""),
    (5, "http://b.example.com:8080/", "é\r\n\r\nWARC/1.1\r\n漢"), (6, "http://bad host/\r\n", "<p>one</p>"), (None, "http://c/", "<p>one</p>"),
    (None, "http://c/", "alone"), (8, "http://a.example.com/x", "z" * 300_000), (9, "http://[::1", "same id"), (9, "http://[::1", "same id"),
]


def test_round_trip(spark):
    df = pages(spark, ROWS)
    archives, index = warc.archive_and_index(df)
    got = warc.read_index(spark, index)
    first = {}
    for i, _, h in ROWS:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    expected = []
    for i, _, h in ROWS:
        raw, f = (h or "").encode(), first.get(h or "")
        revisit = f is not None and i != f
        expected.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    rows = [tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(rows, key=str) == sorted(expected, key=str)


def test_look_up(spark):
    archives = warc.write_archives(pages(spark, ROWS), f"{warc.shared_folder(spark)}/w1")
    path = warc.write_index(warc.read_archives(spark, archives), f"{warc.shared_folder(spark)}/i1", block_lines=2)
    index = warc.Index(spark, path)
    assert len(index.entries) >= 5 and warc.lines_for(10**12) * warc.MOST_BLOCKS > 10**12
    found = index.lookup("http://a.example.com/x")
    assert sorted(r["page_id"] for r, _ in found) == [1, 8]
    for r, record in found:
        (_, n, fields, block), = warc.parse_archive(record)
        assert n == r["length"] and fields["X-Page-Id"] == str(r["page_id"])
        assert block.partition(b"\r\n\r\n")[2].decode() == dict((i, h) for i, _, h in ROWS)[r["page_id"]]
    assert index.lookup("http://nowhere.example.com/") == []


def test_bulk_look_up_reads_found_blocks_only(spark):
    """What comes through directory and blocks is what a scan of all captures gives, also for keys that go over several blocks."""
    rows = [*ROWS, *((100 + i, "http://many.example.com/same", f"page {i}") for i in range(7)), *((200 + i, f"http://h{i}.example.org/p", "x") for i in range(9))]
    archives = warc.write_archives(pages(spark, rows), f"{warc.shared_folder(spark)}/w2")
    path = warc.write_index(warc.read_archives(spark, archives), f"{warc.shared_folder(spark)}/i2", block_lines=2)
    asked = spark.createDataFrame([("http://many.example.com/same", "x"), ("http://h3.example.org/p", "x"), (None, "x"), ("http://nowhere.org/", "x"), ("http://many.example.com/same", "y")], "url string, file string")
    got = sorted(r.page_id for r in warc.find_captures(spark, path, asked).collect())
    assert got == [3, 4, *range(100, 107), 203]
    whole = warc.find_captures(spark, path, spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, warc.read_index(spark, path).collect()))
    directory = warc.read_directory(spark, path).collect()
    assert sum(r.captures for r in directory) == len(rows) and all(r.first_key <= r.last_key for r in directory)
    index = warc.Index(spark, path)
    for r in directory:
        block = warc.decode_block(index.read(r.file, r.offset, r.length).decode())
        assert (block[0]["urlkey"], block[-1]["urlkey"], len(block)) == (r.first_key, r.last_key, r.captures)


def test_large_payloads_have_files_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(warc, "LARGE", 100)
    monkeypatch.setattr(warc, "MOST_FILE_BYTES", 5000)
    rows = [(i, f"http://a/{i}", "y" * (3000 if i % 3 else 10) + str(i)) for i in range(30)]
    archives = warc.write_archives(pages(spark, rows), f"{warc.shared_folder(spark)}/w3")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(archives).select("length").collect()
    assert max(r.length for r in files) < 15_000
    assert warc.read_archives(spark, archives).count() == 30


def test_keys():
    assert warc.url_key("http://WWW.Example.com/a?b=c") == "com,example,www)/a?b=c"
    assert warc.url_key("https://x.org:8443") == "org,x:8443)/"
    assert warc.url_key(None) == ""


def test_least_size_and_empty(spark):
    df = warc.with_first(pages(spark, ROWS), min_bytes=100)
    assert df.where("first is not null").count() == 0
    _, index = warc.archive_and_index(pages(spark, ROWS).where(F.lit(False)))
    assert warc.read_index(spark, index).collect() == []
