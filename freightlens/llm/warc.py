"""Operator 2: WARC archives, written and read back with segment reassembly.

Writing: a page's payload (its html in UTF-8) goes into an HTTP response block
with chunked transfer framing.  A block beyond ``SEGMENT_BYTES`` is cut: the
first record carries segment number 1, continuation records name the first as
their origin and number themselves, the last gives the total length.  Of equal
payloads of ``REVISIT_BYTES`` or more, the smallest page_id's is the response;
the others are revisit records without payload that refer to it.  Each task
rolls its archives every ``ARCHIVE_BYTES``; Spark's text writer commits them
(gzip), so a lost executor leaves no half archives.

Reading: each archive is parsed record by record by Content-Length.  Whole
records are decoded at once; segments are grouped by origin, put in order,
checked for gaps and total length, joined and then decoded.  Both check the
payload's digest.  A group is one page, so no group grows with the input.

Edge cases: a null html is an empty payload; null page_ids and urls are left
out of the headers and read back as null; rows of equal page_id and payload are
responses (the smallest page_id is theirs too); payloads whose page_ids are all
null are all responses; a null page_id whose payload has a page_id elsewhere is a
revisit.  A record that can't be rebuilt (a segment missing, a length or digest
that differs) reads back with ``complete`` false and a null payload.  Empty
tables give empty archives and an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SEGMENT_BYTES, CHUNK_BYTES, REVISIT_BYTES, ARCHIVE_BYTES = 64 << 10, 16 << 10, 100, 32 << 20
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i:i + size]), payload[i:i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size:end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        at = end + 4 + size


def _record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, "WARC-Date": DATE, **fields, "Content-Length": len(block)}.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def records(page_id, url, payload: bytes, digest: str, refers_to, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page, without the two line ends that close a record."""
    name = f"<urn:uuid:{uuid.uuid4()}>"
    url = None if url is None else "".join(c if 0x20 < ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)
    known = {"WARC-Record-ID": name, "WARC-Target-URI": url, "X-Page-ID": page_id, "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": len(payload)}
    if refers_to is not None:
        return [_record("revisit", known | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": refers_to, "Content-Type": "application/http; msgtype=response"}, b"HTTP/1.1 200 OK\r\n\r\n")]
    known["Content-Type"] = "application/http; msgtype=response"
    block = _HTTP + chunked(payload)
    if len(block) <= segment:
        return [_record("response", known, block)]
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    out = [_record("response", known | {"WARC-Segment-Number": 1}, parts[0])]
    for k, part in enumerate(parts[1:], 2):
        last = {"WARC-Segment-Total-Length": len(block)} if k == len(parts) else {}
        out.append(_record("continuation", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": k} | last, part))
    return out


def _with_firsts(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.cast("binary").alias("payload"), F.sha2(html.cast("binary"), 256).alias("digest"))
    firsts = C.saved(rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest")
                     .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "warc-firsts")
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES, archive: int = ARCHIVE_BYTES) -> None:
    """WARC files (gzip) under ``path``; records are closed by the writer's line separator."""

    def work(batches):
        size, number = 0, 0
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            out, at, held = [], [], 0
            for i in range(batch.num_rows):
                for r in records(*(c[i].as_py() for c in cols), segment):
                    if size + len(r) > archive and size:
                        size, number = 0, number + 1
                    size += len(r) + len(END)
                    out.append(r)
                    at.append(number)
                    held += len(r)
                if held > C.STEP_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(at, pa.int32())], names=["record", "archive"])
                    out, at, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(at, pa.int32())], names=["record", "archive"])

    made = C.small_batches(_with_firsts(pages)).mapInArrow(work, "record binary, archive int")
    (made.select(F.col("record").cast("string").alias("value"), "archive")
     .write.option("lineSep", END.decode()).option("compression", "gzip").partitionBy("archive").text(path))


def parse(data: bytes):
    """(fields, block) of each record of an archive, gzip or not."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            d = zlib.decompressobj(31)
            parts.append(d.decompress(data) + d.flush())
            data = d.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        end = data.index(END, at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        yield fields, data[end + 4:end + 4 + size]
        at = end + 4 + size + len(END)


def payload_of(block: bytes, digest: str | None) -> bytes | None:
    """The payload of a whole HTTP response block, if it is what its digest says."""
    head, _, body = block.partition(END)
    try:
        out = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError:
        return None
    return out if digest is None or digest == f"sha256:{hashlib.sha256(out).hexdigest()}" else None


_PARSED = {"page_id": T.StringType(), "url": T.StringType(), "record_type": T.StringType(), "refers_to": T.StringType(), "digest": T.StringType(),
           "length": T.LongType(), "origin": T.StringType(), "number": T.IntegerType(), "total": T.LongType(), "block": T.BinaryType()}


def _parsed(files: DataFrame, segments: bool) -> DataFrame:
    """The records of the archives: whole ones with their payload, or the segments with their blocks."""

    def work(batches):
        names = list(_PARSED)
        kinds = [pa.int64() if isinstance(t, T.LongType) else pa.int32() if isinstance(t, T.IntegerType) else pa.binary() if isinstance(t, T.BinaryType) else pa.string() for t in _PARSED.values()]
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for f, block in parse(content.as_py()):
                    if ("warc-segment-number" in f) != segments:
                        continue
                    kind = f["warc-type"]
                    if not segments:
                        block = payload_of(block, f.get("warc-payload-digest")) if kind == "response" else None
                    number = int(f["warc-segment-number"]) if segments else None
                    total = f.get("warc-segment-total-length")
                    rows.append((f.get("x-page-id"), f.get("warc-target-uri"), kind, f.get("x-refers-to-page"), f.get("warc-payload-digest"),
                                 int(f["x-payload-length"]) if "x-payload-length" in f else None,
                                 f.get("warc-segment-origin-id", f["warc-record-id"]), number, int(total) if total else None, block))
                    held += len(block or b"")
                    if held > C.STEP_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    return C.small_batches(files).mapInArrow(work, T.StructType([T.StructField(k, t) for k, t in _PARSED.items()]))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Per page: page_id (text), url, record_type, refers_to (text), digest and length
    as stated, payload (null for revisits), complete."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    out = ["page_id", "url", "record_type", "refers_to", "digest", "length"]

    @F.arrow_udf(T.BinaryType())
    def joined(numbers: pa.Array, blocks: pa.Array, total: pa.Array, digest: pa.Array) -> pa.Array:
        done = []
        for n, b, t, d in zip(numbers, blocks, total, digest):
            block = b"".join(b.as_py())
            whole = n.as_py() == list(range(1, len(n) + 1)) and t.as_py() == len(block)
            done.append(payload_of(block, d.as_py()) if whole else None)
        return pa.array(done, pa.binary())

    whole = _parsed(files, False).select(*out, F.col("block").alias("payload"))
    parts = F.sort_array(F.collect_list(F.struct("number", "block")))
    cut = (_parsed(files, True).groupBy("origin")
           .agg(parts.alias("parts"), F.max("total").alias("total"),
                *(F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in out))
           .select(*out, joined("parts.number", "parts.block", "total", "digest").alias("payload")))
    return whole.unionByName(cut).withColumn("complete", (F.col("record_type") == "revisit") | F.col("payload").isNotNull())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to, complete."""
    pages = C.table(spark, sf_dir, "pages")
    path = C.scratch(spark, "warc")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, path).select(
        F.col("page_id").cast(kind).alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "length").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.substring_index("digest", ":", -1)).alias("payload_digest"),
        "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "complete")


SQL = f"""
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, true AS complete
FROM p LEFT JOIN f USING (payload_digest)
"""
