"""WARC archives with revisit resolution.

``resolve`` shuffles only headers (identifier, digest, length) by payload digest: of records with equal
payloads of at least ``least_bytes`` one is the original, the others revisit it. ``write_archive`` writes
deduplicated WARC/1.1 files with fresh headers: responses with their payload, revisits with the headers of the
identical-payload-digest profile and no payload. ``read_archive`` reads such files back, checks every
digest, and ``join_revisits`` resolves revisits against their responses.

Files are written by Spark's text writer (so through any file system that Spark knows, with its commit protocol: a
lost task leaves no half archive) as gzip files; a record ends with two line breaks, the last line feed of
which is the writer's own. They are then renamed to .warc.gz. They are read as binary files, inflated and
parsed as streams by their content lengths, never by searching payloads.

Edge cases: a null payload is empty; empty and small payloads are never revisits; of equal payloads that with
the largest page_id is the response, and rows that repeat that page_id are responses all; a null page_id
counts as smaller than any other, and records with equal payloads that all have none are responses; line
breaks in a URL are percent-encoded, so they cannot make headers; a null URL has no header and comes
back null; payloads of any length are written and checked whole; an empty table gives an empty archive; other
columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, written

LEAST_BYTES = 1000
#: Records of one file at most, and the payload from which a record has a file of its own: a file of others holds 1 GB at most.
FILE_RECORDS = 1000
LARGE_BYTES = 1_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archives of one run are the same for the same records.
DATE = "2024-01-01T00:00:00Z"
_CRLF = "\r\n"


def headers(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, payload_digest, payload_bytes."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))


def resolve(heads: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """heads(page_id, payload_digest, payload_bytes) -> payload_digest, original_id, only for payloads that
    come more than once. Counted by digest before the shuffle, so copies of one payload travel once a task."""
    large = heads.filter(F.col("payload_bytes") >= least_bytes)
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("original_id"), F.count(F.lit(1)).alias("n"))
    return groups.filter("n > 1 AND original_id IS NOT NULL").drop("n")


def mark(pages: DataFrame, least_bytes: int = LEAST_BYTES, heads: DataFrame | None = None) -> DataFrame:
    """pages(page_id, url, html), heads (see ``headers``) -> pages with payload_digest, payload_bytes and refers_to (null: a response).

    The table of repeated payloads is written, so the planner knows its size: small, it is broadcast; else
    the join is a shuffle in which a payload with very many copies may be split.
    """
    heads = written(headers(pages), "warc-headers") if heads is None else heads
    originals = written(resolve(heads, least_bytes), "warc-originals")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    revisit = F.col("original_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original_id"))
    joined = keyed.join(originals, "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(revisit, F.col("original_id"))).drop("original_id")


def _uri(col):
    """Blanks and control characters of a URL as percent codes."""
    out = col
    for c, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        out = F.replace(out, F.lit(c), F.lit(code))
    return out


def _record_id(col):
    """Names page and payload, so that rows that repeat a page_id have one identifier only if their payloads are equal."""
    return F.concat(F.lit("<urn:wordloom:page:"), F.coalesce(col.cast("string"), F.lit("")), F.lit(":"), F.col("payload_digest"), F.lit(">"))


def record():
    """A WARC record as text, from page_id, url, html, payload_digest, payload_bytes, refers_to."""
    is_revisit = F.col("refers_to").isNotNull()
    payload = F.when(is_revisit, F.lit("")).otherwise(F.coalesce(F.col("html"), F.lit("")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_CRLF + _CRLF))
    block = F.concat(http, payload)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), _uri(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to")))),
        F.when(is_revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    # concat_ws leaves nulls out; the writer ends each value with a line feed
    return F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF + _CRLF), block, F.lit("\r\n\r"))


def write_archive(marked: DataFrame, path: str, largest: int | None = None) -> None:
    """Writes the records of marked (see ``mark``) as .warc.gz files in the folder ``path``. ``largest``: bytes of the largest
    payload, if known; without large ones the pages are read once."""
    large = F.col("payload_bytes") > LARGE_BYTES
    if largest is None:
        largest = marked.agg(F.max("payload_bytes")).first()[0] or 0
    for rows, most in [(marked.filter(~large), FILE_RECORDS), (marked.filter(large), 1)]:
        if most > 1 or largest > LARGE_BYTES:
            out = rows.select(record().alias("value")).write.mode("append").option("lineSep", "\n").option("compression", "gzip")
            out.option("maxRecordsPerFile", most).text(path)
    spark = marked.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.endswith(".txt.gz"):
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt.gz") + ".warc.gz"))


def inflate(data: bytes, step: int = 1 << 20):
    """Pieces of a gzip file of any number of members."""
    unzip = zlib.decompressobj(31)
    at = 0
    while at < len(data) or unzip.unconsumed_tail:
        part = unzip.unconsumed_tail or data[at : at + step]
        if not unzip.unconsumed_tail:
            at += len(part)
        piece = unzip.decompress(part, step)
        if piece:
            yield piece
        if unzip.eof:
            at -= len(unzip.unused_data)
            unzip = zlib.decompressobj(31)


def records(data: bytes):
    """(headers, block) of each record of an archive; header names in lower case."""
    pieces = inflate(data) if data[:2] == b"\x1f\x8b" else iter([data])
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while need(1):
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not need(len(held) + 1):
                raise ValueError("the archive ends within a record's headers")
        version, *lines = held[:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"no record begins with {version[:40]!r}")
        head = {}
        for line in lines:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        del held[: end + 4]
        if not need(size + 4) or held[size : size + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield head, bytes(held[:size])
        del held[: size + 4]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """record_id, url, record_type, payload_digest, payload_bytes (null for revisits), refers_to."""
    names = ["record_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to"]

    def run(batches):
        for b in batches:
            for data in b.column(0):
                rows = []
                for head, block in records(data.as_py()):
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    size = None
                    if head["warc-type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        size = len(payload)
                        if hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"the payload of {head['warc-record-id']} has another digest")
                    rows.append((head["warc-record-id"], head.get("warc-target-uri"), head["warc-type"], digest, size, head.get("warc-refers-to")))
                    if len(rows) == 5000:
                        yield _batch(rows, names)
                        rows = []
                yield _batch(rows, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    return files.mapInArrow(run, "record_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string")


def _batch(rows: list, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    kinds = [pa.int64() if n == "payload_bytes" else pa.string() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def join_revisits(read: DataFrame) -> DataFrame:
    """Gives each revisit the length of the payload that it refers to. Responses are joined by record, one row
    for each identifier and digest."""
    responses = read.filter("record_type = 'response'").groupBy(F.col("record_id").alias("of"), F.col("payload_digest").alias("of_digest")).agg(F.max("payload_bytes").alias("of_bytes"))
    hit = (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("of_digest"))
    joined = read.join(responses, hit, "left")
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "of_bytes")).drop("of", "of_digest", "of_bytes")


def op2_warc(spark, sf_dir) -> DataFrame:
    path = scratch(spark, "archive")
    pages = table(spark, sf_dir, "pages")
    heads = written(headers(pages), "warc-headers")
    write_archive(mark(pages, heads=heads), path, heads.agg(F.max("payload_bytes")).first()[0] or 0)
    read = join_revisits(written(read_archive(spark, path), "warc-read"))
    page = lambda c: F.regexp_extract(F.col(c), "^<urn:wordloom:page:(-?[0-9]+):[0-9a-f]{40}>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "url")


#: The result of op2_warc in DuckDB's SQL.
ORACLE = """
WITH h AS (SELECT page_id, coalesce(html, '') AS html, replace(replace(replace(replace(url, chr(13), '%0D'), chr(10), '%0A'), chr(9), '%09'), ' ', '%20') AS url FROM pages),
d AS (SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM h),
o AS (SELECT payload_digest, max(page_id) AS original_id FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN original_id IS NULL OR page_id = original_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = original_id THEN NULL ELSE original_id END AS refers_to, url
FROM d LEFT JOIN o USING (payload_digest)
"""
