"""WARC writing with identical-payload revisits, and a salvage reader.

Archives are ordinary multi-member gzip WARC files, one member per record, written
by Spark's text sink (its line separator is an empty gzip member). The reader takes
any ``.warc``/``.warc.gz`` bytes: a record must decompress, parse and match its
lengths and digests; after a failed check the reader searches for the next valid
member or version line, goes on from there, and logs the skipped bytes as a gap.

Defined results: a null html is an empty payload; a null url has no target header; a
null page id is written as ``null`` and is never the record others refer to unless
all equal payloads have null ids (then all are responses); rows repeating the
response's page id and payload are responses too; an empty table gives no archive
and no record; other input columns are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import map_arrow

RECORDS_PER_ARCHIVE = 2000
GZIP_EMPTY = bytes.fromhex("1f8b08000000000000ff03000000000000000000")   # an empty gzip member
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY_SCHEMA = ("archive string, kind string, start long, stop long, reason string, record_type string, "
                "record_id string, target_uri string, refers_to string, payload_bytes long, "
                "payload_digest string, payload binary")


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- writing -----------------------------------------------------------------

def plan_records(pages: DataFrame) -> DataFrame:
    """Each page with ``refers_to``: the largest page id of its payload where that is
    another page. Payload groups are reduced to one row before the join; a hot
    payload's rows sit on the join's splittable side."""
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "digest", F.sha1(F.col("html").cast("binary")))
    groups = keyed.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    several = groups.filter("n > 1 and first_id is not null").drop("n")
    other = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return keyed.join(several, "digest", "left").select(
        "page_id", "url", "html", F.when(other, F.col("first_id")).alias("refers_to"))


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One WARC record as a gzip member. A revisit keeps the HTTP head, whose
    Content-Length tells the full payload's size."""
    name = lambda x: "null" if x is None else str(x)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
              f"WARC-Record-ID: <urn:page:{name(page_id)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + "".join(c if c >= " " else f"%{ord(c):02X}" for c in url))
    if revisit:
        fields += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    fields += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}",
               "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_archives(pages: DataFrame, path: str, records_per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                ids, urls, html, refs = (c.to_pylist() for c in b.slice(at, 512).columns)
                out = [record(i, u, h.encode(), r) for i, u, h, r in zip(ids, urls, html, refs)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    (map_arrow(plan_records(pages), members, "member binary").select(F.col("member").cast("string").alias("value"))
     .write.option("encoding", "ISO-8859-1").option("lineSep", GZIP_EMPTY.decode("latin-1"))
     .option("maxRecordsPerFile", records_per_archive).text(path))


# --- salvage reading -----------------------------------------------------------

class Bad(Exception):
    pass


def _member(data: memoryview, at: int, window: int = 16384) -> tuple[bytes, int]:
    """The decompressed gzip member at ``at`` and where it ends; fed in windows, so
    the bytes behind it are not copied."""
    z, pos, out = zlib.decompressobj(31), at, []
    try:
        while not z.eof:
            if pos >= len(data):
                raise Bad("truncated member")
            out.append(z.decompress(data[pos: pos + window]))
            pos += window
    except zlib.error as e:
        raise Bad(f"bad member: {e}") from None
    return b"".join(out), min(pos, len(data)) - len(z.unused_data)


def _parse(raw, start: int = 0) -> tuple[dict, int]:
    """The WARC record in ``raw`` at ``start``, all checks passed, and its end."""
    if bytes(raw[start: start + 7]) != b"WARC/1.":
        raise Bad("no version line")
    cut = raw.find(b"\r\n\r\n", start)
    if cut < 0:
        raise Bad("no end of header")
    fields = {}
    for line in raw[start:cut].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise Bad("bad header line")
        fields[key.strip().lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get(b"content-length", "")
    if not length.isdigit():
        raise Bad("no length")
    body, stop = cut + 4, cut + 4 + int(length)
    if raw[stop: stop + 4] != b"\r\n\r\n":
        raise Bad("length does not end at a record end")
    block = raw[body:stop]
    told = fields.get(b"warc-block-digest", "").removeprefix("sha1:")
    if told and told != digest32(block):
        raise Bad("block digest differs")
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, told = fields.get(b"warc-type"), fields.get(b"warc-payload-digest", "").removeprefix("sha1:")
    size = len(payload)
    if kind == "revisit":
        sizes = [x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(sizes[0]) if sizes else 0
    elif told and told != digest32(payload):
        raise Bad("payload digest differs")
    clean = lambda k: (fields.get(k) or "").strip("<>").removeprefix("urn:page:") or None
    return {"record_type": kind, "record_id": clean(b"warc-record-id"), "target_uri": fields.get(b"warc-target-uri"),
            "refers_to": clean(b"warc-refers-to"), "payload_bytes": size, "payload_digest": told or digest32(payload),
            "payload": None if kind == "revisit" else payload}, stop + 4


def _read_at(data: bytes, view: memoryview, at: int) -> tuple[dict | None, int]:
    """The record at ``at`` (None for an empty gzip member) and the next position."""
    if data[at: at + 2] == b"\x1f\x8b":
        raw, end = _member(view, at)
        if not raw:
            return None, end
        rec, used = _parse(raw)
        if used != len(raw):
            raise Bad("bytes after the record in its member")
        return rec, end
    return _parse(data, at)


def salvage(data: bytes) -> Iterator[tuple[str, int, int, str | None, dict | None]]:
    """Records and quarantined gaps of one archive, in order:
    (``record`` or ``gap``, start, stop, reason, fields)."""
    view, at, gap, reason = memoryview(data), 0, None, None
    while at < len(data):
        try:
            rec, end = _read_at(data, view, at)
            if gap is not None and rec is None:      # an empty member proves nothing; the gap goes on
                raise Bad(reason)
        except Bad as e:
            gap, reason = (at, str(e)) if gap is None else (gap, reason)
            nexts = [p for p in (data.find(b"\x1f\x8b\x08", at + 1), data.find(b"WARC/1.", at + 1)) if p >= 0]
            at = min(nexts, default=len(data))
            continue
        if gap is not None:
            yield "gap", gap, at, reason, None
            gap = None
        if rec is not None:
            yield "record", at, end, None, rec
        at = end
    if gap is not None:
        yield "gap", gap, len(data), reason, None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records (``kind = 'record'``) and quarantined byte ranges (``kind = 'gap'``) of all
    archives under ``path``, one row each."""
    names = [x.split()[0] for x in ENTRY_SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ENTRY_SCHEMA.split(", ")])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                archive, data = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                rows, size = [], 0
                for kind, start, stop, reason, rec in salvage(data):
                    rows.append({"archive": archive, "kind": kind, "start": start, "stop": stop, "reason": reason, **(rec or {})})
                    size += stop - start
                    if size > 2 << 20:
                        yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return map_arrow(files, entries, ENTRY_SCHEMA)
