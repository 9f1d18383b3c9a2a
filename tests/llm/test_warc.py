import base64
import gzip
import hashlib

import pytest

from ledgerlens.llm import warc as W
from ledgerlens.llm.common import scratch

SCHEMA = "page_id long, url string, html string, payload string"
PAGES = [(1, "http://a/1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://a/\r\nX: y", "<p>ü</p>"), (4, "u", None), (5, "u", ""),
         (6, "u", "<p>x</p>"), (6, "u", "<p>x</p>"), (None, "u", "<p>x</p>"), (None, "u", "alone"), (None, "u", "alone"),
         (7, "u", "WARC/1.0 \r\n\r\n\x1f not a record" * 50), (8, "u", "y" * 300_000)]


def brute(pages):
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        ids = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        other = bool(ids) and max(ids) != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if other else "response",
                    max(ids) if other else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    path = scratch(spark, "warc-test")
    W.write_archives(spark.createDataFrame([(*p, "clash") for p in PAGES], SCHEMA), path, records_per_archive=3)
    rows = W.read_archives(spark, path).collect()
    assert all(r.kind == "record" for r in rows)
    num = lambda x: None if x in (None, "null") else int(x)
    got = sorted(((num(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, num(r.refers_to)) for r in rows), key=str)
    assert got == brute(PAGES)
    payloads = {r.payload_digest: bytes(r.payload) for r in rows if r.record_type == "response"}
    assert all(W.digest32(v) == k for k, v in payloads.items())


def test_archives_are_ordinary_gzip_warc(spark, tmp_path):
    W.write_archives(spark.createDataFrame([(*PAGES[0], "c")], SCHEMA), str(tmp_path / "a"))
    (part,) = (tmp_path / "a").glob("part-*")
    raw = gzip.decompress(part.read_bytes())
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"<p>x</p>\r\n\r\n")


def test_empty_table(spark):
    path = scratch(spark, "warc-none")
    W.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert W.read_archives(spark, path).count() == 0


def members():
    return [W.record(i, f"http://h/{i}", b"payload %d " % i * 40, None) for i in range(6)]


@pytest.mark.parametrize("damage", ["flip", "cut", "insert", "head", "tail", "checksum"])
def test_salvage_finds_the_records_behind_damage(damage):
    m = members()
    if damage == "flip":
        m[2] = m[2][:60] + bytes([m[2][60] ^ 0xFF]) + m[2][61:]
    elif damage == "cut":
        m[2] = m[2][: len(m[2]) // 2]
    elif damage == "insert":
        m.insert(2, b"junk \x1f\x8b\x08 WARC/1.1 junk")
    elif damage == "head":
        m[0] = m[0][5:]
    elif damage == "tail":
        m[5] = m[5][:-3]
    else:
        m[2] = m[2][:-8] + b"\0\0\0\0" + m[2][-4:]
    data = b"".join(m)
    found = list(W.salvage(data))
    lost = {"flip": {2}, "cut": {2}, "insert": set(), "head": {0}, "tail": {5}, "checksum": {2}}[damage]
    assert {int(f["record_id"]) for kind, *_, f in found if kind == "record"} == set(range(6)) - lost
    gaps = [x for x in found if x[0] == "gap"]
    assert len(gaps) == 1 and gaps[0][3]
    covered = sum(stop - start for _, start, stop, *_ in found)
    assert covered == len(data)                       # every byte is in a record or in a logged gap


def test_salvage_reads_plain_records_by_version_line():
    plain = [gzip.decompress(x) for x in members()]
    bad = plain[1].replace(b"payload", b"Payload", 1)          # digest no longer right
    found = list(W.salvage(plain[0] + bad + plain[2]))
    assert [(k, f and f["record_id"]) for k, *_, f in found] == [("record", "0"), ("gap", None), ("record", "2")]
    assert "digest" in found[1][3]
    assert list(W.salvage(b"")) == [] and [x[0] for x in W.salvage(b"nothing here")] == ["gap"]
