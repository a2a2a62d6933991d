"""WARC archives with a two-level capture index.

``write_archives`` turns pages into WARC/1.1 records (one text file per task, bounded by
``FILE_BYTES``); the first page of each group of equal payloads is a response, the others revisit it.
``read_archives`` parses the files again, record by record, and recomputes each payload's digest.
``write_index`` sorts captures by reversed-host URL keys and packs them, ``BLOCK_LINES`` at a time, into
compressed blocks, and writes the directory beside them: one entry per block with its first and last key and
where it stands. ``find_captures`` looks up many URLs: each is binary-searched in the sparse directory and only
blocks found through it are decoded. ``Index`` answers single URLs by range reads of a block and of a record.

Archives and index are plain files, written and read by Spark or Hadoop's file system, so any store works.
Groups of equal payloads are aggregated before shuffling. While they number ``GROUP_ROWS`` at most they are
broadcast and payload texts stay where they were read; beyond that texts cross one shuffle, whose hot keys
AQE splits.

Edge cases: null html is an empty payload; equal payloads under a null page_id revisit the least non-null
one; pages with neither are responses; repeated rows of the least page_id are all responses; a null url is
kept as null; extra columns are ignored; an empty table gives empty archives.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_folder, shuffle_partitions, stored

FILE_BYTES = 32 << 20
#: Archive files stay under so many bytes, as readers take them whole.
MOST_FILE_BYTES = 1 << 30
#: Payloads beyond this are written to files of their own kind, so that no run of them makes a file too large.
LARGE = 1 << 20
BLOCK_LINES = 3000
#: Groups of equal payloads (under 100 bytes each) that may be broadcast; beyond that payloads are shuffled.
GROUP_ROWS = 200_000
#: Entries of the directory (about 150 bytes each) that may be held at once. ``lines_for`` makes blocks so large that
#: they stay far below it, however many captures there are.
MOST_BLOCKS = 500_000
END = "\r\n\r\n"
CAPTURE = "urlkey string, url string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(value: Column) -> Column:
    """SHA-1 in RFC 4648's base 32: 5 hexadecimal digits at a time are 4 of base 32."""
    digest = F.sha1(value)
    parts = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_first(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, bytes, digest, first): first is the page that holds the payload, null if it is this one."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.octet_length(payload).cast("long").alias("bytes"), base32_sha1(payload).alias("digest"))
    groups = rows.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    groups = cut(groups)
    groups = F.broadcast(groups) if groups.count() <= GROUP_ROWS else groups
    is_first = F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(groups, ["digest", "bytes"], "left").withColumn("first", F.when(~is_first, F.col("first")))


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-" if a > 1 else ""), F.substring(h, a, n))], F.lit(">"))


def records(rows: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(value): a whole record as text, without the two line ends that close it."""
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    url = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", url),
        field("X-Page-Id", F.col("page_id").cast("string")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Profile", F.when(revisit, REVISIT)),
        field("WARC-Refers-To", F.when(revisit, _record_id(F.col("first"), F.col("digest")))),
        field("X-Refers-To-Page-Id", F.col("first").cast("string")),
        field("Content-Type", F.lit("application/http;msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(head, F.lit("\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> str:
    bytes_ = F.coalesce(F.octet_length("html"), F.lit(0))
    small = F.when(bytes_ <= LARGE, bytes_)
    facts = pages.agg((F.avg(small) + 700).alias("mean"), F.max(F.when(bytes_ > LARGE, bytes_)).alias("most")).first()
    rows = with_first(pages, min_bytes)
    to = lambda df, n: records(df).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", max(1, n)).text(path)
    to(rows.where(F.col("bytes") <= LARGE), min(int(FILE_BYTES / (facts["mean"] or 700)), MOST_FILE_BYTES // (2 * LARGE)))
    if facts["most"]:
        to(rows.where(F.col("bytes") > LARGE), MOST_FILE_BYTES // (2 * facts["most"]))
    return path


_UNSAFE = re.compile(r"[\x00-\x20]")


def url_key(url: str | None) -> str:
    """Reversed host, then the rest: http://a.example.com/x?y is com,example,a)/x?y."""
    if not url:
        return ""
    url = _UNSAFE.sub("%20", url)  # as records hold it
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return f"{key}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def parse_archive(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, fields, block) of each record."""
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        end = stop + 4 + int(fields["Content-Length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end at {end}")
        yield at, end + 4 - at, fields, content[stop + 4 : end]
        at = end + 4


def capture(file: str, offset: int, length: int, fields: dict[str, str], block: bytes) -> dict:
    """What the index says of a record; of a response the digest is that of the payload as read."""
    http, _, payload = block.partition(b"\r\n\r\n")
    whole = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        seen = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if seen != digest or len(payload) != whole:
            raise ValueError(f"the payload at {file}:{offset} is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    url = fields.get("WARC-Target-URI")
    return {"urlkey": url_key(url), "url": url, "page_id": number("X-Page-Id"), "payload_bytes": whole, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"), "file": file, "offset": offset, "length": length}


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A capture for each record of the archives."""
    schema = _arrow(CAPTURE)

    def parse(batches):
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                file = file.as_py()
                rows = [capture(file, *x) for x in parse_archive(content.as_buffer().to_pybytes() if content.is_valid else b"")]
                for i in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 5000], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    return files.mapInArrow(parse, CAPTURE)


def lines_for(captures: int) -> int:
    """Captures for each block, so that a directory of any index can be held."""
    return max(BLOCK_LINES, -(-captures // (MOST_BLOCKS // 4)))


DIRECTORY = "first_key string, last_key string, captures long, offset long, length long, file string"


def write_index(captures: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> str:
    """Folders path/blocks and path/directory. A block is a line: its offset in the file, its first and last key, its number of captures, and its compressed lines."""

    def pack(batches):
        lines, offset = [], 0

        def block():
            data = base64.b64encode(zlib.compress("\n".join(lines).encode(), 6)).decode()
            ends = "\t".join(json.dumps(json.loads(x)["urlkey"]) for x in (lines[0], lines[-1]))
            line = f"{offset}\t{ends}\t{len(lines)}\t{data}"
            return line, pa.RecordBatch.from_arrays([pa.array([line])], ["value"])

        for batch in batches:
            for row in batch.to_pylist():
                lines.append(json.dumps(row))
                if len(lines) == block_lines:
                    line, out = block()
                    offset += len(line) + 1
                    yield out
                    lines.clear()
        if lines:
            yield block()[1]

    key = ("urlkey", "page_id", "file", "offset")
    spark = captures.sparkSession
    captures.repartitionByRange(shuffle_partitions(spark), *key).sortWithinPartitions(*key).mapInArrow(pack, "value string").write.text(f"{path}/blocks")
    _blocks(spark, path).drop("value").write.parquet(f"{path}/directory")
    return path


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """DIRECTORY and value: each block's line with what its head says."""
    head = F.split("value", "\t", 5)
    name = lambda i: F.from_json(F.concat(F.lit('{"k":'), head[i], F.lit("}")), "k string")["k"]
    rows = spark.read.text(f"{path}/blocks").select("value", F.col("_metadata.file_path").alias("file"))
    return rows.select(name(1).alias("first_key"), name(2).alias("last_key"), head[3].cast("long").alias("captures"), head[0].cast("long").alias("offset"), F.octet_length("value").cast("long").alias("length"), "file", "value")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DIRECTORY).parquet(f"{path}/directory")


def decode_block(line: str) -> list[dict]:
    return [json.loads(x) for x in zlib.decompress(base64.b64decode(line.rsplit("\t", 1)[1])).decode().split("\n")]


def _decoded(blocks: DataFrame) -> DataFrame:
    schema = _arrow(CAPTURE)

    def unpack(batches):
        for batch in batches:
            for line in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(decode_block(line), schema)

    return blocks.select("value").mapInArrow(unpack, CAPTURE)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """All captures of the index's blocks."""
    return _decoded(spark.read.text(f"{path}/blocks"))


def _search(directory: list[tuple[str, str]], key: str) -> range:
    """Numbers of the blocks (first and last keys, sorted) that may hold a key."""
    first = bisect.bisect_left(directory, key, key=lambda x: x[1])
    return range(first, bisect.bisect_right(directory, key, key=lambda x: x[0]))


def find_captures(spark: SparkSession, path: str, urls: DataFrame) -> DataFrame:
    """The captures of every URL (column url) that urls holds: directory first, then the blocks found through it."""
    keys_of = lambda batches: (pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string())], ["urlkey"]) for b in batches)
    asked = stored(urls.select("url").distinct().mapInArrow(keys_of, "urlkey string").distinct(), "keys")
    directory = read_directory(spark, path)
    if (n := directory.count()) > MOST_BLOCKS:
        raise ValueError(f"{n} blocks: build the index with larger ones (lines_for)")
    rows = sorted((r.first_key, r.last_key, r.file, r.offset) for r in directory.select("first_key", "last_key", "file", "offset").collect())
    shared = spark.sparkContext.broadcast(([r[:2] for r in rows], [r[2:] for r in rows]))

    def search(batches):
        ends, places = shared.value
        for batch in batches:
            found = sorted({i for key in batch.column(0).to_pylist() for i in _search(ends, key)})
            yield pa.RecordBatch.from_arrays([pa.array([places[i][0] for i in found], pa.string()), pa.array([places[i][1] for i in found], pa.int64())], ["file", "offset"])

    found = asked.mapInArrow(search, "file string, offset long").distinct()
    blocks = _blocks(spark, path).join(found, ["file", "offset"], "left_semi")
    return _decoded(blocks).join(asked, "urlkey", "left_semi").select(*(x.split()[0] for x in CAPTURE.split(", ")))


class Index:
    """Point look-ups: the directory is searched, blocks and records are read by their ranges."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.directory = spark, read_directory(spark, path)
        self.entries = None
        if self.directory.count() <= MOST_BLOCKS:
            self.entries = sorted((r.first_key, r.last_key, r.file, r.offset, r.length) for r in self.directory.collect())

    def read(self, file: str, offset: int, length: int) -> bytes:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(file)
        stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(path)
        try:
            stream.seek(offset)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
        finally:
            stream.close()

    def blocks(self, key: str) -> list[tuple[str, int, int]]:
        """(file, offset, length) of blocks that may hold a key."""
        if self.entries is not None:
            return [self.entries[i][2:] for i in _search([x[:2] for x in self.entries], key)]
        rows = self.directory.where((F.col("first_key") <= key) & (F.col("last_key") >= key))  # row groups are sorted: their statistics rule most of them out
        return [(r.file, r.offset, r.length) for r in rows.collect()]

    def captures(self, url: str) -> list[dict]:
        key = url_key(url)
        rows = [r for place in self.blocks(key) for r in decode_block(self.read(*place).decode())]
        return [r for r in rows if r["urlkey"] == key]

    def lookup(self, url: str) -> list[tuple[dict, bytes]]:
        """The captures of a URL with their records as they stand in the archive."""
        return [(r, self.read(r["file"], r["offset"], r["length"])) for r in self.captures(url)]


def archive_and_index(pages: DataFrame, min_bytes: int = 0) -> tuple[str, str]:
    """Folders of the archives and of their index, new ones in the shared folder."""
    spark = pages.sparkSession
    base = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(pages, f"{base}/archives", min_bytes)
    return archives, write_index(read_archives(spark, archives), f"{base}/index", lines_for(pages.count()))
