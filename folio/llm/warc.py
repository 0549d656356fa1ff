"""WARC archives: writing captures with deduplicated payloads, reading them back, assembling transactions.

Writing uses Spark's text sink with the record separator CRLF CRLF: every row is one whole record, so files commit and
recover like any other output of Spark, on any file system, without Python. The records of a capture are a request, a
response or revisit, and a metadata record that names the row; the last two point at the first by WARC-Concurrent-To.

Of captures with equal payloads of at least MIN_REVISIT bytes (equal length and SHA-256) the one with the largest id
holds the payload; the others are revisits and refer to it.

Files hold at most MAX_RECORDS records, and fewer where payloads are long: pages are written by classes of size (CLASSES),
so that no file comes near the 2 GB that one value of Spark can hold. Reading takes whole files, plain or gzip (by member
or whole), and walks the records by Content-Length. assemble() joins the records of each transaction by the record they have in common
(the one that the others name in WARC-Concurrent-To, or themselves) and gives one nested row per capture.

Defined cases: a null html is an empty payload; a null url an empty one; rows with a null id are captures like others and
hold a payload only where no row with an id has the same one; ids may be of any type that has a text; repeated rows are a capture each; further columns are
ignored; an empty table gives no rows; a file that isn't WARC or is cut short raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialise, only, scratch_path

MIN_REVISIT = 1000
MAX_RECORDS = 2000
CLASSES = ((1 << 18, MAX_RECORDS), (1 << 22, 150), (1 << 31, 3))  # bytes of payload, and how many records a file may hold up to there
HOLDER_ROWS = 100_000  # of about 100 bytes: up to here the table of shared payloads is broadcast
DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


# --- writing ------------------------------------------------------------------------------------------------------


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _holders(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, payload, size, digest) with holder: the id of the row that holds the same payload.

    Holders are aggregated from digests alone, and only payloads of several rows are kept, so no payload is moved to
    find them. The table is counted: up to HOLDER_ROWS it is broadcast and payloads aren't moved to join it either.
    """
    big = pages.where(F.col("size") >= MIN_REVISIT)
    same = big.groupBy("digest", "size").agg(F.max("page_id").alias("holder"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    same = materialise(same, "holders")
    if same.count() <= HOLDER_ROWS:
        same = F.broadcast(same)
    return pages.join(same, ["digest", "size"], "left")


def records(pages: DataFrame, over: int = -1, up_to: int = 1 << 31) -> DataFrame:
    """(value): the WARC records of each page, without the CRLF CRLF that ends a record.

    over, up_to: only pages whose payload has so many bytes; they refer to holders among all of their size.
    """
    p = only(pages, "page_id", "url", "html").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("size", F.octet_length("payload").cast("long")).where((F.col("size") > over) & (F.col("size") <= up_to))
    p = p.withColumn("digest", F.sha2("payload", 256))
    p = _holders(p)
    urn = lambda c: _text("<urn:uuid:", c, ">")

    def named(row: str) -> Column:
        """The record that holds a payload has a name-based UUID, which revisits can know."""
        h = F.sha1(F.concat_ws("|", F.col(row).cast("string"), "digest"))
        at = lambda a, n: F.substring(h, a, n)
        return urn(_text(at(1, 8), "-", at(9, 4), "-5", at(14, 3), "-8", at(18, 3), "-", at(21, 12)))

    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    p = p.withColumns({"revisit": revisit, "request_id": urn(F.uuid()), "metadata_id": urn(F.uuid()), "other_id": urn(F.uuid())})
    own = F.when(~F.col("revisit") & F.col("holder").isNotNull(), named("holder")).otherwise(F.col("other_id"))

    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    host, path = F.regexp_extract(uri, r"://([^/?#]*)", 1), F.regexp_extract(uri, r"://[^/?#]*([^#]*)", 1)
    http = _text("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.col("size").cast("string"), CRLF, CRLF)

    def record(kind: Column | str, ident: Column, content_type: str, more: Column | str, block: Column) -> Column:
        head = _text("WARC/1.1\r\nWARC-Type: ", kind, "\r\nWARC-Record-ID: ", ident, f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: ", uri, CRLF, more)
        return _text(head, f"Content-Type: {content_type}\r\nContent-Length: ", F.octet_length(block).cast("string"), CRLF, CRLF, block)

    to = _text("WARC-Concurrent-To: ", F.col("request_id"), CRLF)
    back = F.when(F.col("revisit"), _text(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: ", named("holder"), CRLF)).otherwise(F.lit(""))
    request = record("request", F.col("request_id"), "application/http; msgtype=request", "", _text("GET ", F.when(path == "", F.lit("/")).otherwise(path), " HTTP/1.1\r\nHost: ", host, CRLF, CRLF))
    kind = F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    response = record(kind, own, "application/http; msgtype=response", F.concat(to, _text("WARC-Payload-Digest: sha1:", F.sha1("payload"), CRLF), back), block)
    ident = F.col("page_id").cast("string")  # none for null, two quotation marks for an empty one
    row = F.when(ident == "", F.lit('""')).otherwise(F.coalesce(F.url_encode(ident), F.lit("")))
    metadata = record("metadata", F.col("metadata_id"), "application/warc-fields", to, _text("row: ", row, CRLF))
    return p.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write(pages: DataFrame, path: str, max_records: int = MAX_RECORDS) -> None:
    """Write pages (page_id, url, html) as WARC files under path, one class of size that occurs after the other."""
    longest = only(pages, "html").agg(F.coalesce(F.max(F.octet_length("html")), F.lit(0)).alias("n")).first()["n"]
    over = -1
    for up_to, many in CLASSES:
        if over < longest:
            out = records(pages, over, up_to).write.mode("append" if over >= 0 else "error").option("lineSep", CRLF + CRLF)
            out.option("maxRecordsPerFile", min(many, max_records)).text(path)
        over = up_to


# --- reading ------------------------------------------------------------------------------------------------------

RECORD = "type string, record_id string, concurrent_to string, refers_to string, uri string, date string, payload_digest string, http string, payload_bytes long, payload_sha1 string, fields string"


def _plain(content: bytes) -> bytes:
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        d = zlib.decompressobj(31)
        out.append(d.decompress(content))
        if not d.eof:
            raise ValueError("a gzip member is cut short")
        content = d.unused_data
    return b"".join(out)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(headers with lower-case names, block) of each record of a file."""
    data = memoryview(content)
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if not content.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        head: dict[str, str] = {}
        for line in content[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head.setdefault(name.strip().lower(), value.strip())
        at, size = end + 4, int(head["content-length"])
        if content[at + size : at + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {end} is cut short")
        yield head, data[at : at + size]
        at += size + 4


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row for each record under path; payload: with the bytes of payloads, else with their length and SHA-1 alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in RECORD.split(", ")] + [("payload", pa.binary())] * payload)
        for b in batches:
            for content in b.column("content"):
                rows, held = [], 0
                for head, block in parse(_plain(content.as_py())):
                    kind = head.get("warc-type")
                    row = dict.fromkeys(schema.names)
                    row |= {"type": kind, "record_id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "payload_digest": head.get("warc-payload-digest")}
                    if kind in ("request", "response", "revisit"):
                        raw = bytes(block)
                        http, _, body = raw.partition(b"\r\n\r\n")
                        row["http"] = http.decode("utf-8", "replace")
                        if kind == "response":
                            row |= {"payload_bytes": len(body), "payload_sha1": hashlib.sha1(body).hexdigest()}
                            if payload:
                                row["payload"] = body
                                held += len(body)
                    elif kind == "metadata":
                        row["fields"] = bytes(block).decode("utf-8", "replace")
                    rows.append(row)
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, RECORD + ", payload binary" * payload)


def assemble(records: DataFrame) -> DataFrame:
    """(uri, date, request, response, metadata): a nested row for each response or revisit of the records.

    response holds the record's kind, ids, digest and payload (or its length and SHA-1); request and metadata are null
    where the transaction has none, and the least by record id where it has several.
    """
    r = records.withColumn("_hub", F.coalesce("concurrent_to", "record_id"))
    part = lambda kind, name, *cols: r.where(F.col("type") == kind).groupBy("_hub").agg(F.min(F.struct("record_id", *cols)).alias(name))
    body = ["payload"] if "payload" in records.columns else []
    responses = r.where(F.col("type").isin("response", "revisit")).select("_hub", "uri", "date", F.struct("type", "record_id", "refers_to", "payload_digest", "http", "payload_bytes", "payload_sha1", *body).alias("response"))
    both = responses.join(part("request", "request", "http"), "_hub", "left").join(part("metadata", "metadata", "fields"), "_hub", "left")
    return both.select("uri", "date", "request", "response", "metadata")


def resolve(captures: DataFrame, kind: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of assembled captures; ids are of type kind.

    A revisit takes length and digest from the record that it refers to, as that was read.
    """
    row = F.regexp_extract("metadata.fields", r"(?m)^row: ([^\r\n]*)", 1)
    row = F.when(row == '""', F.lit("")).when(row != "", F.url_decode(row)).cast(kind)
    c = captures.select(row.alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.record_id").alias("record_id"), F.col("response.refers_to").alias("refers"), F.col("response.payload_bytes").alias("n"), F.col("response.payload_sha1").alias("sha"))
    c = materialise(c, "captures")
    held = c.where("record_type = 'response'").groupBy("record_id").agg(F.min("page_id").alias("holder"), F.min("n").alias("held_n"), F.min("sha").alias("held_sha")).withColumnRenamed("record_id", "refers")
    held = materialise(held, "held")
    own = c.where("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    again = c.where("record_type = 'revisit'").join(held, "refers", "left").select("page_id", F.col("held_n").alias("payload_bytes"), F.col("held_sha").alias("payload_digest"), "record_type", F.col("holder").alias("refers_to"))
    return own.unionByName(again)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder, read those back and resolve them."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path)
    found = materialise(read(spark, path, payload=False), "records")
    return resolve(assemble(found), pages.schema["page_id"].dataType.simpleString())


# SHA-256 picks the groups in Spark; equal payloads are grouped by themselves here.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, h, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM q
"""
