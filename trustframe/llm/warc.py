"""WARC archives: writing, segment reassembly, chunked decoding, revisits.

Writing: each page is one ``response`` record holding an HTTP message in
chunked transfer framing.  Of equal payloads of ``REVISIT_BYTES`` or more only
the largest page_id is stored, the others become ``revisit`` records that
refer to it.  A block longer than ``SEGMENT_BYTES`` is cut: the first segment
carries segment number 1, ``continuation`` records carry the origin's record
id and their number, the last one the total length.  Records are bounded, and
so are the files (``FILE_RECORDS``); Spark's writer makes them, so they go
wherever Spark can write, and a lost task only repeats its own files.

Reading: records are cut out by Content-Length.  Segments are grouped by
origin id, ordered by number and verified against number and total length
before the framing is decoded; a failed check gives ``complete`` = false and
no payload.  A revisit takes length and digest from the record it refers to.

Null html is an empty payload.  Rows that repeat a page_id and payload are
records of their own with one id; repeated segments are told by that.  A null
page_id is never the response of others; null urls have no target URI.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.session import checkpoint_dir

from .common import bounded_batches, salted_lookup

REVISIT_BYTES = 1000
SEGMENT_BYTES = 1 << 15
CHUNK_BYTES = 1 << 12
FILE_RECORDS = 500
BATCH_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"
_END = "\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(c), c) for c in
           (payload[i:i + size] for i in range(0, len(payload), size))]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk without end")
        out.append(body[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes | None:
    """Payload of an HTTP message; None if it is not whole."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        return None
    if b"transfer-encoding: chunked" in head.lower():
        try:
            return dechunked(body)
        except ValueError:
            return None
    return body


def _uri(url: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def _record(fields: list[tuple], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def records(page_id, url, payload: bytes, digest: str, target, segment: int = SEGMENT_BYTES):
    """The records of one page, without the line ends that separate records."""
    name = f"urn:page:{'null' if page_id is None else page_id}:{digest}"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", None if url is None else _uri(url)),
              ("WARC-Payload-Digest", f"sha1:{digest}")]
    kind = ("Content-Type", "application/http;msgtype=response")
    if target is not None and target != page_id:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), *common,
                       ("WARC-Refers-To", f"<urn:page:{target}:{digest}>"),
                       ("WARC-Profile", _PROFILE), kind], _HTTP + b"\r\n")
        return
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    first = [("WARC-Segment-Number", 1)] if len(parts) > 1 else []
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *common,
                   *first, kind], parts[0])
    for n, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", len(block))] if n == len(parts) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:{n}>"),
                       *common, ("WARC-Segment-Origin-ID", f"<{name}>"),
                       ("WARC-Segment-Number", n), *total], part)


def parse(stream):
    """(header fields in lower case, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one should start: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            head[k.lower()] = v
        block = stream.read(int(head["content-length"]))
        stream.read(len(_END))
        yield head, block


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url",
          html: str = "html", segment: int = SEGMENT_BYTES) -> None:
    """Write the archives of ``pages`` as gzip files under ``path``."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"),
                        F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    target = (rows.where(F.length("payload") >= REVISIT_BYTES).groupBy("digest")
                  .agg(F.max("page_id").alias("target"), F.count("*").alias("n"))
                  .where("n > 1").drop("n"))
    marked = salted_lookup(rows, target, "digest", F.col("page_id"))

    def run(batches):
        for b in batches:
            out, size = [], 0
            for row in zip(*(b.column(c) for c in ("page_id", "url", "payload", "digest", "target"))):
                for r in records(*(x.as_py() for x in row), segment):
                    out.append(r)
                    size += len(r)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    (marked.select("page_id", "url", "payload", "digest", "target")
           .mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
           .write.option("lineSep", _END).option("compression", "gzip")
           .option("maxRecordsPerFile", FILE_RECORDS).text(path))


_PARSED = ("page_id long, record_id string, record_type string, refers_to long, "
           "refers_record string, origin string, segment int, total long, "
           "payload_digest string, payload_bytes long, payload binary")


def _page_of(name: str | None) -> int | None:
    part = (name or "<urn:page:null:").split(":")[2]
    return None if part == "null" else int(part)


def _parsed(spark: SparkSession, path: str, segments: bool, payloads: bool) -> DataFrame:
    """Whole records (decoded), or only the segments (``payload`` is the block part)."""
    def run(batches):
        for b in batches:
            for content in b.column("content"):
                out, size = [], 0
                for head, block in parse(io.BufferedReader(gzip.GzipFile(
                        fileobj=io.BytesIO(content.as_py())))):
                    number = head.get("warc-segment-number")
                    if (number is not None) != segments:
                        continue
                    own, refers = head["warc-record-id"], head.get("warc-refers-to")
                    kind = head["warc-type"]
                    row = [_page_of(own), own, kind, refers and _page_of(refers), refers,
                           head.get("warc-segment-origin-id", own),
                           number and int(number), None, None, None, None]
                    if segments:
                        total = head.get("warc-segment-total-length")
                        row[7], row[10] = total and int(total), block
                    elif kind == "revisit":
                        row[8] = head["warc-payload-digest"].partition(":")[2]
                    else:
                        got = payload_of(block)
                        if got is not None:
                            row[8], row[9] = hashlib.sha1(got).hexdigest(), len(got)
                            row[10] = got if payloads else None
                    out.append(row)
                    size += len(row[10] or b"") + 300
                    if size >= BATCH_BYTES:
                        yield _batch(out)
                        out, size = [], 0
                if out:
                    yield _batch(out)

    return (spark.read.format("binaryFile").load(path).select("content")
                 .mapInArrow(run, _PARSED))


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(),
             pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in _PARSED.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)


def _reassembled(segments: DataFrame, payloads: bool) -> DataFrame:
    """One row per segmented record and copy, decoded once its parts are verified."""
    one = (segments.groupBy("origin", "segment")
           .agg(F.first("payload").alias("part"), F.max("total").alias("total"),
                F.count("*").alias("copies")))
    whole = one.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "part"))).alias("parts"),
        F.max("total").alias("total"), F.max("segment").alias("last"),
        F.max(F.when(F.col("segment") == 1, F.col("copies"))).alias("copies"))

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():          # a batch is bounded in bytes, one page's parts at least
                block = b"".join(p["part"] for p in r["parts"])
                ok = len(r["parts"]) == r["last"] and len(block) == r["total"]
                got = payload_of(block) if ok else None
                row = [_page_of(r["origin"]), r["origin"], "response", None, None, r["origin"],
                       None, r["total"], None, None, None]
                if got is not None:
                    row[8], row[9] = hashlib.sha1(got).hexdigest(), len(got)
                    row[10] = got if payloads else None
                out += [row] * (r["copies"] or 1)
            if out:
                yield _batch(out)

    return whole.mapInArrow(run, _PARSED)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every page of the archives under ``path``.

    page_id, record_type, refers_to, payload_bytes, payload_digest, complete
    and, unless ``payloads`` is false, payload (null for revisits).
    """
    bounded_batches(spark)
    single = _parsed(spark, path, False, payloads)
    joined = _reassembled(_parsed(spark, path, True, payloads), payloads)
    responses = single.where("record_type = 'response'").unionByName(joined)
    revisits = single.where("record_type = 'revisit'")
    referred = revisits.select(F.col("refers_record").alias("record_id")).distinct()
    stored = (responses.select("record_id", "payload_digest", "payload_bytes")
                       .join(referred, "record_id").groupBy("record_id")
                       .agg(F.max("payload_digest").alias("stored_digest"),
                            F.max("payload_bytes").alias("stored_bytes"))
                       .withColumnRenamed("record_id", "refers_record"))
    found = salted_lookup(revisits, stored, "refers_record", F.col("record_id"))
    same = F.col("stored_digest") == F.col("payload_digest")
    resolved = (found.withColumn("payload_bytes", F.when(same, F.col("stored_bytes")))
                     .drop("stored_digest", "stored_bytes"))
    keep = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    return (responses.unionByName(resolved)
            .select(*keep, F.col("payload_bytes").isNotNull().alias("complete"),
                    *(["payload"] if payloads else [])))


def archive_path(spark: SparkSession) -> str:
    """A new folder for archives in the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"warc-{uuid.uuid4().hex}")
