"""WARC archives: writing with revisit records, and segment reassembly.

Writing. Each page is one record whose block is an HTTP response in chunked
transfer framing. Pages are grouped by payload digest (only ids and digests
are shuffled); the smallest page_id of a payload is the response, the others
are revisits of it. A block longer than ``segment_bytes`` is cut into a first
record and continuation records that name its id as their origin. Records are
written as files of ``CRLF CRLF``-ended records by Spark's text writer, to the
folder the caller names; cuts lie between characters, so each record is text.

Reading. Files are read as binary, one task per group of files
(``records_per_file`` bounds a file), and parsed by Content-Length, so any
content may hold anything. Unsegmented records are done there; segments are
grouped by their origin id, ordered by segment number, checked against the
total length that the last one carries, and joined; then the chunked framing
is taken off. A broken record (missing, repeated or short segments, bad
framing) keeps its row with a null digest and ``complete`` false.

Edge cases: null html is an empty payload; null url stands as an empty target;
pages that repeat an id each have a record (ids carry the row's place in the
scan, so ``pages`` must be a stored table or another repeatable plan), the
first being the response; a null page_id stays null and is a response only if all
its equals are null; other columns are ignored; no pages give no records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourse.llm import textcols as T

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _cut(data: bytes, at: int) -> int:
    """The last character border at or before ``at``."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of at most ``size`` (4 at least) bytes, cut between characters."""
    size, at = max(4, size), 0
    while at < len(data):
        stop = _cut(data, at + size) if at + size < len(data) else len(data)
        yield data[at:stop]
        at = stop


def chunked(payload: bytes, size: int) -> bytes:
    """Payload in chunked transfer framing."""
    out = [b"%x\r\n%s\r\n" % (len(p), p) for p in pieces(payload, size)]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunk(body: bytes) -> bytes | None:
    """Payload of a chunked body (chunk extensions and trailers allowed); None if it is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        at = line + 2
        if size == 0:
            return b"".join(out)
        out.append(body[at:at + size])
        if len(out[-1]) != size or body[at + size:at + size + 2] != b"\r\n":
            return None
        at += size + 2


def payload_of(block: bytes) -> bytes | None:
    """Payload of an HTTP response block; None if the framing is broken."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    coded = any(k.strip().lower() == b"transfer-encoding" and b"chunked" in v.lower()
                for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]))
    return unchunk(body) if coded else body


def record(kind: str, record_id: str, fields: dict[str, object], block: bytes) -> str:
    """One record without the closing CRLF CRLF (the writer adds it)."""
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Date: {DATE}\r\n"]
    head += [f"{k}: {v}\r\n" for k, v in fields.items()]
    return "".join(head) + f"Content-Length: {len(block)}\r\n\r\n" + block.decode()


def _writer(segment_bytes: int, chunk_bytes: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[str] = []
            size = 0
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for row, page, url, html, refers in zip(*cols, strict=True):
                payload = (html or "").encode()
                rid = f"urn:x-page:{'' if page is None else page}:{row}"
                fields: dict[str, object] = {"WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%"),
                                             "WARC-Payload-Digest": f"sha1:{digest(payload)}"}
                if refers is not None:
                    fields |= {"WARC-Refers-To": f"<urn:x-page:{refers}>", "WARC-Payload-Length": len(payload),
                               "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    out.append(record("revisit", rid, fields, b""))
                else:
                    block = HTTP + chunked(payload, chunk_bytes)
                    parts = list(pieces(block, segment_bytes))
                    if len(parts) > 1:
                        fields["WARC-Segment-Number"] = 1
                    out.append(record("response", rid, fields, parts[0]))
                    for n, part in enumerate(parts[1:], 2):
                        extra = {"WARC-Segment-Origin-ID": f"<{rid}>", "WARC-Segment-Number": n}
                        if n == len(parts):
                            extra["WARC-Segment-Total-Length"] = len(block)
                        out.append(record("continuation", f"{rid}:{n}", extra, part))
                size += len(payload)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
    return run


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        data, off = T.column(batch, "html")
        got = [hashlib.sha1(data[a:b]).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*T.keep_columns(batch, ["row_id", "page_id"]), pa.array(got, pa.binary())],
                                         names=["row_id", "page_id", "digest"])


def write_archives(pages: DataFrame, path: str, *, min_revisit_bytes: int = 0, segment_bytes: int = 16384,
                   chunk_bytes: int = 4096, records_per_file: int = 1000) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files below ``path``."""
    rows = (pages.select(F.monotonically_increasing_id().alias("row_id"), F.col("page_id").cast("long"),
                         F.col("url").cast("string"), F.col("html").cast("string")))
    known = (rows.where(F.coalesce(F.octet_length("html"), F.lit(0)) >= min_revisit_bytes)
             .select("row_id", "page_id", "html").mapInArrow(_digests, "row_id long, page_id long, digest binary"))
    # ids and digests only: the first of each payload, then the rows that repeat one
    known = known.checkpoint()
    order = F.struct(F.col("page_id").isNull(), "page_id", "row_id")
    first = known.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = (known.join(first, "digest").where(F.col("row_id") != F.col("first.row_id"))
             .select(F.col("row_id").alias("of"), F.concat_ws(":", F.coalesce(F.col("first.page_id").cast("string"), F.lit("")),
                                                              F.col("first.row_id").cast("string")).alias("refers"))
             .checkpoint())
    # the repeats may be few (Spark then broadcasts them below its own limit) or a third of all rows
    marked = rows.join(again, rows.row_id == again.of, "left").select("row_id", "page_id", "url", "html", "refers")
    (marked.mapInArrow(_writer(segment_bytes, chunk_bytes), "value string")
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive file: header fields (lower-case names) and block."""
    at = 0
    while True:
        while data[at:at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        gap = data.find(b"\r\n\r\n", at)
        if gap < 0 or data[at:at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for line in data[at:gap].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        length = int(fields["content-length"])
        yield fields, data[gap + 4:gap + 4 + length]
        at = gap + 4 + length


RECORD_DDL = ("record_id string, kind string, target string, digest string, refers string, payload_bytes long, "
              "segment int, total long, block binary")
_KINDS = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
_NAMES = [x.split()[0] for x in RECORD_DDL.split(", ")]


def _unzip(data: bytes) -> bytes:
    """Plain bytes; gzip files may have several members."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def _read_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def number(x: str | None) -> int | None:
        return int(x) if x and x.isdigit() else None

    for batch in it:
        for content in batch.column(0):
            rows: list[tuple] = []
            size = 0
            for f, block in parse(_unzip(content.as_py())):
                kind = f.get("warc-type")
                origin = (f.get("warc-segment-origin-id") or f.get("warc-record-id") or "").strip("<>")
                rows.append((origin, kind, unquote(f.get("warc-target-uri", "")), f.get("warc-payload-digest"),
                             (f.get("warc-refers-to") or "").strip("<>") or None, number(f.get("warc-payload-length")),
                             number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), block))
                size += len(block)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``; record_id is the origin's for continuations."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").option("recursiveFileLookup", "true")
            .load(path).select("content").mapInArrow(_read_batches, RECORD_DDL))


def _join_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows = []
        for r in batch.to_pylist():
            block = b"".join(p["block"] for p in r["parts"])
            in_order = [p["segment"] for p in r["parts"]] == list(range(1, len(r["parts"]) + 1))
            rows.append((r["record_id"], r["kind"], r["target"], r["digest"], r["refers"], r["payload_bytes"], None,
                         r["total"], block, in_order and r["total"] == len(block)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [*_KINDS, pa.bool_()], strict=True)],
            names=[*_NAMES, "complete"])


def reassemble(records: DataFrame) -> DataFrame:
    """Whole blocks of segmented records: grouped by origin, ordered, length checked.

    Columns as ``read_records``, plus ``complete``. A group is one record's
    segments, so it is as large as that record.
    """
    part = F.col("segment").isNotNull()
    whole = records.where(~part).withColumn("complete", F.lit(True))
    seg = (records.where(part).groupBy("record_id")
           .agg(F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"),
                *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
                  for c in ("kind", "target", "digest", "refers", "payload_bytes")]))
    whole_segments = seg.mapInArrow(_join_batches, RECORD_DDL + ", complete boolean")
    return whole.unionByName(whole_segments)


PAGE_DDL = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
            "complete boolean, row_id long, target string, payload binary")


def _page_batches(payloads: bool):
    def page(urn: str | None) -> tuple[int | None, int | None]:
        a, _, b = (urn or "").removeprefix("urn:x-page:").partition(":")
        return (int(a) if a else None), (int(b) if b else None)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for r in batch.to_pylist():
                page_id, row_id = page(r["record_id"])
                if r["kind"] == "revisit":
                    stated = (r["digest"] or "").removeprefix("sha1:") or None
                    rows.append((page_id, r["payload_bytes"], stated, "revisit", page(r["refers"])[0], True, row_id,
                                 r["target"], None))
                    continue
                body = payload_of(r["block"] or b"") if r["complete"] else None
                found = None if body is None else digest(body)
                sound = body is not None and r["digest"] in (None, f"sha1:{found}")
                rows.append((page_id, None if body is None else len(body), found, r["kind"], None, sound, row_id,
                             r["target"], body if payloads else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(),
                     pa.binary()]
            names = [x.split()[0] for x in PAGE_DDL.split(", ")]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    return run


def read_pages(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """One row per archived page; ``payloads`` keeps the decoded bytes."""
    cols = ["record_id", "kind", "target", "digest", "refers", "payload_bytes", "block", "complete"]
    return reassemble(read_records(spark, path)).select(*cols).mapInArrow(_page_batches(payloads), PAGE_DDL)
