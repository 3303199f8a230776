"""WARC archives: writing with segmentation and chunked payloads, and reading with segment reassembly.

Writing. A page becomes an HTTP response in a WARC record; its payload is framed in chunks (Transfer-Encoding:
chunked), and a block longer than `segment_bytes` is cut into segments: the first in the response record, the others in
continuation records that name it by WARC-Segment-Origin-ID and count up WARC-Segment-Number, the last with
WARC-Segment-Total-Length. Of pages with equal payloads that with the least id is the response, the others become
revisit records. Records are written by Spark's text writer, whose line separator is the two CRLFs that end a record,
so that archives are ordinary files of whatever store the path names.

Reading. Archives are read as binary files and cut into records by Content-Length. Records of one segment pass straight
through; continuation records meet by origin, a bounded group (the segments of one payload), are ordered by number, and
the sum of their lengths is verified against the total before the chunks are decoded.

Defined results: a null html counts as empty; a null page id is always a response; equal ids with equal payloads are all
responses; an empty frame gives archives without records; extra columns are ignored. A segment that is missing, a total
or digest that differs, broken chunks, a header that is cut off or has no length give complete = false and no payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm import bits as B
from tessera.llm._common import U64, settle

SEGMENT_BYTES, CHUNK_BYTES = 16 << 10, 4 << 10
#: Bytes of an archive before compression, for records with headers of up to HEAD bytes; and of a piece that is unpacked.
FILE_BYTES, HEAD, PIECE = 128 << 20, 1 << 10, 1 << 20
CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(out) + b"0\r\n\r\n"


def dechunk(framed: bytes) -> bytes | None:
    """The payload of a chunked body, or None where its framing is broken or cut off."""
    out, at = [], 0
    while True:
        to = framed.find(CRLF, at)
        size = framed[at:to].split(b";")[0].strip() if to >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            return None
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        if framed[to + 2 + n : to + 4 + n] != CRLF:
            return None
        out.append(framed[to + 2 : to + 2 + n])
        at = to + 4 + n


def record_id(page, segment: int = 1) -> str:
    return f"<urn:tessera:page:{page}:{segment}>"


def _record(kind: str, rid: str, uri: str, block: bytes, more: list[tuple[str, str]], mime: str = "application/http;msgtype=response") -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Target-URI", uri), *more, ("Content-Type", mime), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v != "").encode() + CRLF + block


def records_of(rid_key, page, url: str, payload: bytes | None, length: int, sha1: str, refers_to, refers_uri: str, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page: a response with its continuations, or a revisit, which needs length and hash alone."""
    digest, uri = base64.b32encode(bytes.fromhex(sha1)).decode(), re.sub(r"\s", "%20", url)
    own = [("WARC-Payload-Digest", f"sha1:{digest}"), ("Tessera-Page", "" if page is None else str(page))]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return [_record("revisit", record_id(rid_key), uri, block, [*own, profile, ("WARC-Refers-To", record_id(refers_uri)), ("Tessera-Refers-To-Page", str(refers_to))])]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record("response", record_id(rid_key), uri, parts[0], own + ([("WARC-Segment-Number", "1")] if len(parts) > 1 else []))]
    for k, part in enumerate(parts[1:], 2):
        seg = [("WARC-Segment-Origin-ID", record_id(rid_key)), ("WARC-Segment-Number", str(k))] + ([("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else [])
        out.append(_record("continuation", record_id(rid_key, k), uri, part, seg, "application/octet-stream"))
    return out


def originals(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, digest, refers_to) of the pages that revisit another. Payloads are hashed and aggregated before the shuffle;
    AQE splits the rows of a payload that very many pages share."""
    p = settle(pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")).alias("digest")).filter("id is not null"), "payloads")
    first = settle(p.groupBy("digest").agg(F.min("id").alias("refers_to"), F.max("id").alias("last")).filter("refers_to <> last").drop("last"), "originals")
    return p.join(first, "digest").filter("id <> refers_to").select("id", "refers_to", "digest").distinct()


def with_originals(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, html, n, digest, refers_to, key, refers_key) of every page.

    Payloads don't move: pages that no bounded filter takes for a revisit pass straight through. Of the others length,
    hash and names meet the revisits, whose records have no payload; the few that only the filter took for one are told
    apart by a second filter and read again.
    """
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html").cast("long"))
    revisits = settle(originals(pages, id_col, html_col), "revisits")
    columns = ["id", "url", "html", "n", "digest", "refers_to", "key", "refers_key"]
    key = F.concat_ws("-", F.coalesce(F.col("id").cast("string"), F.lit("none")), "digest").alias("key")
    response = lambda df: df.withColumn("refers_to", F.lit(None).cast("long")).withColumn("refers_key", F.lit(None).cast("string")).withColumn("key", key).select(columns)
    maybe = _filter_of(revisits)
    met = settle(p.filter(maybe).select("id", "url", "n", "digest").join(revisits, ["id", "digest"], "left"), "met")
    slipped = settle(met.filter("refers_to is null").select("id", "digest").distinct(), "slipped")
    again = p.filter(maybe & _filter_of(slipped)).join(slipped, ["id", "digest"], "left_semi")
    revisit = met.filter("refers_to is not null").withColumn("html", F.lit(None).cast("string")).withColumn("refers_key", F.concat_ws("-", F.col("refers_to").cast("string"), "digest")).withColumn("key", key)
    return response(p.filter(~maybe)).union(response(again)).union(revisit.select(columns))


def _filter_of(pairs: DataFrame) -> Column:
    """Whether a bounded filter holds the row's (id, digest); a null id never is in it."""
    size = B.bits_for(pairs.count())
    hashed = F.xxhash64("id", "digest")
    filled = pairs.sparkSession.sparkContext.broadcast(B.count_bits(pairs.select(hashed), size)[0])

    @F.pandas_udf("boolean")
    def held(h):
        import pandas as pd

        return pd.Series(B.contains(filled.value, h.to_numpy(np.int64).view(U64), size))

    return F.col("id").isNotNull() & held(hashed)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = SEGMENT_BYTES, compression: str | None = "gzip", file_bytes: int = FILE_BYTES) -> None:
    """Write the archives of the pages under a path of any store. No record is longer than a segment and its header, so the
    number of records bounds an archive's bytes."""
    met = with_originals(pages, id_col, url_col, html_col)

    def f(batches):
        for b in batches:
            out, size = [], 0
            for page, url, html, n, sha1, refers_to, key, refers_key in zip(*(c.to_pylist() for c in b.columns)):
                made = records_of(key, page, url or "", None if html is None else html.encode(), n, sha1, refers_to, refers_key, segment_bytes)
                out += made
                size += sum(map(len, made))
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    text = met.mapInArrow(f, "record binary").select(F.col("record").cast("string").alias("value"))
    w = text.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, file_bytes // (segment_bytes + HEAD)))
    (w.option("compression", compression) if compression else w).text(path)


def _pieces(data: bytes, size: int = PIECE):
    """An archive's bytes piece by piece; of a compressed one that is cut off or broken, what comes before."""
    if data[:2] != b"\x1f\x8b":
        for i in range(0, len(data), size):
            yield data[i : i + size]
        return
    d = zlib.decompressobj(31)
    for i in range(0, len(data), size):
        held = data[i : i + size]
        while held:
            try:
                out = d.decompress(held, size)
            except zlib.error:
                return
            if out:
                yield out
            held = d.unused_data if d.eof else d.unconsumed_tail
            if d.eof:
                d = zlib.decompressobj(31)
    if out := d.flush():
        yield out


class _Window:
    """What of an archive is held: from the record that is being read to as far as was looked."""

    def __init__(self, pieces):
        self.pieces, self.held = pieces, bytearray()

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is not None:
            self.held += piece
        return piece is not None

    def find(self, what: bytes, start: int = 0) -> int:
        while (at := self.held.find(what, start)) < 0:
            start = max(start, len(self.held) - len(what) + 1)
            if not self.more():
                return -1
        return at

    def fill(self, n: int) -> None:
        while len(self.held) < n and self.more():
            pass


def parse_records(data: bytes):
    """(headers in lower case, block, whether the record is whole) of every record of an archive, plain or compressed.

    Unpacked bytes are held for one record at a time. A header that is cut off, or that names no length, gives a record
    that isn't whole; the next one begins at the next version line."""
    w = _Window(_pieces(data))
    while (at := w.find(b"WARC/")) >= 0:
        del w.held[:at]
        to = w.find(b"\r\n\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in bytes(w.held[: to if to >= 0 else None]).decode("utf-8", "replace").split("\r\n")[1:])}
        length = head.get("content-length", "")
        if to < 0 or not re.fullmatch("[0-9]{1,15}", length):
            yield head, b"", False
            following = w.find(b"\r\n\r\nWARC/")
            if following < 0:
                return
            del w.held[: following + 4]
            continue
        end = to + 4 + int(length)
        w.fill(end)
        block = bytes(w.held[to + 4 : end])
        yield head, block, len(block) == int(length)
        del w.held[:end]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, page, url, record_type, refers_to, payload, payload_bytes, payload_digest, complete): one row a page.

    A revisit's length is that of its kept HTTP header, its digest that of its record."""
    schema = "rid string, origin string, segment int, total long, type string, page long, url string, refers_to long, digest string, block binary"

    def cut(batches):
        for b in batches:
            for data in b.column(0):
                out, size = [], 0
                for h, block, whole in parse_records(data.as_py()):
                    if h.get("warc-type", "response") not in ("response", "revisit", "continuation"):
                        continue
                    if not whole:
                        block = b""
                    num = lambda k: int(h[k]) if re.fullmatch("-?[0-9]{1,18}", h.get(k, "")) else None  # noqa: E731, B023
                    segment = num("warc-segment-number") or 0
                    out.append((h.get("warc-record-id"), h.get("warc-segment-origin-id") or h.get("warc-record-id"), min(segment, (1 << 31) - 1), num("warc-segment-total-length"), h.get("warc-type"), num("tessera-page"), h.get("warc-target-uri", ""), num("tessera-refers-to-page"), h.get("warc-payload-digest", "").removeprefix("sha1:"), block))
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], arrow)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], arrow)

    names = [x.split()[0] for x in schema.split(", ")]
    arrow = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for n, x in zip(names, schema.split(", "))])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    records = files.mapInArrow(cut, schema)
    one = F.struct("segment", "block")
    whole = records.filter("segment = 0").select("rid", "type", "page", "url", "refers_to", "digest", F.array(one).alias("parts"), F.lit(None).cast("long").alias("total"))
    # a group is the segments of one record
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    cutup = records.filter("segment > 0").groupBy("origin").agg(first("type"), first("page"), first("url"), first("refers_to"), first("digest"), F.sort_array(F.collect_list(one)).alias("parts"), F.max("total").alias("total")).withColumnRenamed("origin", "rid")

    def join(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                parts = r.pop("parts")
                block = b"".join(p["block"] for p in parts)
                good = r["total"] is None and [p["segment"] for p in parts] == [0] or (len(block) == r["total"] and [p["segment"] for p in parts] == list(range(1, len(parts) + 1)))
                payload, n, digest = None, None, r["digest"]
                if good:
                    head, _, body = block.partition(b"\r\n\r\n")
                    if r["type"] == "revisit":
                        kept = re.search(rb"(?i)\r\ncontent-length:\s*(\d{1,15})", head)
                        good, n = kept is not None, int(kept[1]) if kept else None
                    else:
                        payload = dechunk(body) if re.search(rb"(?i)transfer-encoding:\s*chunked", head) else body
                        good = payload is not None and payload_digest(payload) == r["digest"]
                        payload, n = (payload, len(payload)) if good else (None, None)
                out.append({"page": r["page"], "url": r["url"], "record_type": r["type"], "refers_to": r["refers_to"], "payload": payload, "payload_bytes": n, "payload_digest": digest, "complete": good})
            yield pa.RecordBatch.from_pylist(out, done)

    done = pa.schema([("page", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("complete", pa.bool_())])
    return whole.unionByName(cutup).mapInArrow(join, "page long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, complete boolean")
