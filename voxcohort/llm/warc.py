"""WARC archives written from a table of pages, and read back as a table of chunks.

Payloads are split into chunks of bounded size: one row per record id and chunk
number, which is also how the archive keeps them (a record and its numbered
continuations), so no later step holds a large payload in memory. Equal payloads are
found by digest; the one of the smallest page id is a response, the others revisits
that name it. Archives are written and read by Spark's text source with the blank
line that ends WARC records as separator; each compressed file is read in order by
one task, whose parser follows the stated lengths and so doesn't mind separators in
a payload. Digests of chunked payloads are carried from chunk to chunk.

The digests' join is salted, so a payload that a third of the pages share is spread.
Cases: null html is the empty payload; pages with a null id are responses unless an
equal payload has an id; repeated rows of the response are responses too; line breaks
in a url become spaces; other columns are ignored; no pages give no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxcohort.llm.common import written
from voxcohort.session import ensure_checkpoint_dir

CHUNK = 1 << 18            # characters of a payload in one record
SALTS = 16
SEPARATOR = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"      # fixed value of the format
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexed: Column) -> Column:
    """Base-32 text of a 160-bit digest in hexadecimal: four letters from every five digits."""
    def letter(k):
        bits = F.conv(F.substring(hexed, (F.floor(k / 4) * 5 + 1).cast("int"), F.lit(5)), 16, 10).cast("int")
        at = (F.floor(bits / F.element_at(F.array(*[F.lit(1 << s) for s in (15, 10, 5, 0)]), k % 4 + 1)) % 32 + 1).cast("int")
        return F.substring(F.lit(_BASE32), at, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def chunk_table(pages: DataFrame, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """One row per record and chunk: record, chunk_no, chunks, page_id, url, type, refers_to, digest, bytes, body."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]+", " ").alias("url"), payload.alias("payload"),
                        F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).cast("long").alias("bytes"))
    shared = (rows.where(F.col("bytes") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(shared, ["sha", "salt"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    named = joined.select("page_id", "url", "payload", "bytes", base32(F.col("sha")).alias("digest"), F.when(again, "revisit").otherwise("response").alias("type"),
                          F.when(again, F.col("first")).alias("refers_to"),
                          F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "url", "sha", F.monotonically_increasing_id())).alias("record"))
    parts = F.when(F.col("type") == "response", F.greatest(F.ceil(F.length("payload") / chunk), F.lit(1))).otherwise(F.lit(1)).cast("int")
    cut = named.withColumn("chunks", parts).withColumn("chunk_no", F.explode(F.sequence(F.lit(1), F.col("chunks"))))
    return cut.withColumn("body", F.when(F.col("type") == "response", F.substring("payload", (F.col("chunk_no") - 1) * chunk + 1, F.lit(chunk))).otherwise("")).drop("payload")


def _urn(record: Column) -> Column:
    part = lambda a, n: F.substring(record, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def record_text(date: str = DATE) -> Column:
    """The text of a chunk's WARC record, without the separator behind it."""
    first, last, many = F.col("chunk_no") == 1, F.col("chunk_no") == F.col("chunks"), F.col("chunks") > 1
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(SEPARATOR))
    block = F.when(first, F.concat(http, "body")).otherwise(F.col("body"))
    line = lambda name, value, when=None: F.when(when if when is not None else F.lit(True), F.concat(F.lit(f"{name}: "), value))
    own = F.when(first, F.col("record")).otherwise(F.md5(F.concat_ws("|", "record", "chunk_no")))
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), line("WARC-Type", F.when(first, F.col("type")).otherwise("continuation")),
                       line("WARC-Record-ID", _urn(own)), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.col("url")),
                       line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
                       line("WARC-Profile", F.lit(PROFILE), F.col("type") == "revisit"),
                       line("WARC-Segment-Number", F.col("chunk_no").cast("string"), many),
                       line("WARC-Segment-Origin-ID", _urn(F.col("record")), ~first),
                       line("WARC-Segment-Total-Length", F.col("bytes").cast("string"), many & last),
                       line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
                       line("X-Refers-To-Page", F.col("refers_to").cast("string"), F.col("refers_to").isNotNull()),
                       line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(SEPARATOR), block)


def write_archives(pages: DataFrame, path: str, least: int = 0, chunk: int = CHUNK, date: str = DATE) -> None:
    """Write gzip-compressed WARC files to ``path``, a record per page."""
    chunk_table(pages, least, chunk).select(record_text(date).alias("value")).write.option("lineSep", SEPARATOR).option("compression", "gzip").text(path)


class _Parser:
    """Records out of a stream of bytes that arrives in pieces."""

    def __init__(self):
        self.held, self.head = bytearray(), None

    def feed(self, piece: bytes):
        self.held += piece
        while True:
            if self.head is None:
                at = self.held.find(b"\r\n\r\n")
                if at < 0:
                    return
                lines = self.held[:at].decode().split("\r\n")
                if lines[0] != "WARC/1.1":
                    raise ValueError(f"no record starts with {lines[0][:40]!r}")
                self.head = dict(x.split(": ", 1) for x in lines[1:])
                del self.held[:at + 4]
            size = int(self.head["Content-Length"])
            if len(self.held) < size + 4:
                return
            yield self.head, bytes(self.held[:size])
            del self.held[:size + 4]
            self.head = None

    def end(self):
        if self.head is not None or self.held:
            raise ValueError("the archive ends within a record")


_PARSED = ("origin string, page_id long, record_type string, refers_to long, stated string, payload_bytes long, "
           "payload_digest string, chunk_no int, chunk binary")
_PARSED_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary()]
_NAMES = [x.split()[0] for x in _PARSED.split(", ")]


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _parsed_row(head: dict, block: bytes) -> tuple:
    kind, stated = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
    origin, page, refers = head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"]), _number(head["X-Page-ID"]), _number(head.get("X-Refers-To-Page"))
    size = None
    if kind != "continuation":
        http, _, block = block.partition(b"\r\n\r\n")
        size = int(http.rsplit(b"Content-Length: ", 1)[1])
    if "WARC-Segment-Number" in head:
        return origin, page, kind, refers, stated, size, None, int(head["WARC-Segment-Number"]), block
    if kind == "revisit":
        return origin, page, kind, refers, stated, size, stated, None, None
    return origin, page, kind, refers, stated, len(block), base64.b32encode(hashlib.sha1(block).digest()).decode(), None, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PARSED_TYPES)], _NAMES)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of the archives, with the digest of the payload as read; fails on a wrong digest."""
    def parse(batches):
        parser, rows, size = _Parser(), [], 0
        for batch in batches:
            for line in batch.column(0).to_pylist():
                for head, block in parser.feed(line + b"\r\n\r\n"):
                    rows.append(_parsed_row(head, block))
                    size += len(rows[-1][-1] or b"") + 300
                    if size > 1 << 22:
                        yield _batch(rows)
                        rows, size = [], 0
        parser.end()
        if rows:
            yield _batch(rows)

    def join(batches):
        now, sha, size = None, None, 0      # the record under way, its digest so far, its bytes so far

        def done():
            return _batch([(now[0], now[1], now[2], now[3], now[4], size, base64.b32encode(sha.digest()).decode(), None, None)])
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or row[0] != now[0]:
                    if now is not None:
                        yield done()
                    now, sha, size = row, hashlib.sha1(), 0
                sha.update(row[8])
                size += len(row[8])
        if now is not None:
            yield done()

    lines = spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary"))
    found = written(lines.mapInArrow(parse, _PARSED))
    parts = found.where("chunk_no IS NOT NULL")
    chunked = parts.repartition("origin").sortWithinPartitions("origin", "chunk_no").mapInArrow(join, _PARSED)
    wrong = F.raise_error(F.concat(F.lit("wrong payload digest in "), "origin"))
    return found.where("chunk_no IS NULL").union(chunked).withColumn(
        "payload_digest", F.when(F.col("payload_digest") == F.col("stated"), F.col("payload_digest")).otherwise(wrong)) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write the pages to fresh archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least, chunk)
    return read_archives(spark, path)
