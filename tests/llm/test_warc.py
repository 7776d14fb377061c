import base64
import hashlib
import struct

import pytest
import zstandard

from tesselode.llm.warc import DICT_MAGIC, WarcError, archive_head, parse, read_archive, record, round_trip

SCHEMA = "page_id long, url string, html string, archive string"


def want(rows):
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -(2**70)), -(2**70) if i is None else i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        top = best[h or ""]
        revisit = top > -(2**70) and top != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return out


def key(x):
    return tuple("" if v is None else str(v) for v in x)


def test_round_trip_of_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [tuple(r) for r in pages.collect()]
    got = round_trip(pages).collect()
    assert sorted((g["page_id"], g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"]) for g in got) == sorted(want(rows))
    text = {i: h for i, _, h in rows}
    assert all(g["payload"].decode() == text[g["page_id"]] for g in got if g["record_type"] == "response")
    assert {g["page_id"]: g["url"] for g in got} == {i: u for i, u, _ in rows}


def test_copies_nulls_repeats(spark):
    rows = [(i, "http://a/%d" % i, "same") for i in range(40)] + [(50, None, None), (51, "u", ""), (None, "u", "same"), (None, None, "alone"), (60, "u\r\nX: y", "é" * 9), (60, "u", "é" * 9), (70, "u", "WARC/1.1\r\n\r\n")]
    got = round_trip(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert sorted(map(key, ((g["page_id"], g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"]) for g in got))) == sorted(map(key, want(rows)))
    assert round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def archive(*records, dictionary=b""):
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return archive_head(dictionary) + b"".join(c.compress(r) for r in records)


def test_dictionary_frame_and_damage():
    samples = [b"<html><p>page number %d of the set</p></html>" % (i * 7919) for i in range(3000)]
    d = zstandard.train_dictionary(4096, [record(i, "http://x", x, None, False) for i, x in enumerate(samples)]).as_bytes()
    a, b = record(1, "http://x", samples[1], None, False), record(2, "http://y", samples[1], 1, True)
    data = archive(a, b, dictionary=d)
    assert struct.unpack("<I", data[:4])[0] == DICT_MAGIC and len(data) < len(archive(a, b)) + 8 + len(d)
    x, y = read_archive(data)
    assert x["payload"] == samples[1] and y["payload"] is None and y["payload_bytes"] == len(samples[1])
    packed = zstandard.ZstdCompressor().compress(d)
    assert len(list(read_archive(archive_head(packed) + data[8 + len(d) :]))) == 2
    for broken in (data[:-3], data[: 8 + len(d)] + b"xxxx" + data[8 + len(d) :], data[:9], archive(a + b), archive(a[:-4])):
        with pytest.raises(WarcError):
            list(read_archive(broken))
    for old, new in ((b"WARC/1.1", b"WARC/9.9"), (b"WARC-Type", b"X-Type"), (b"Content-Length: ", b"Content-Length: 1"), (b"sha1:", b"sha1:A"), (b"page number", b"page mumber")):
        with pytest.raises(WarcError):
            parse(a.replace(old, new, 1))


def test_the_session_keeps_its_settings_and_archives_are_found(spark, tmp_path):
    from tesselode.llm.warc import read_archives, write_archives

    before = dict(spark.conf.getAll)
    rows = [(i, f"http://a/{i}", f"<p>page {i}</p>" * 50) for i in range(60)]
    folder = tmp_path.as_uri()
    manifest = write_archives(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), folder)
    got = sorted((r["page_id"], r["payload"].decode()) for r in read_archives(spark, folder).collect())
    assert got == [(i, h) for i, _, h in rows] == sorted((r["page_id"], r["payload"].decode()) for r in read_archives(spark, folder, manifest).collect())
    changed = {k: v for k, v in spark.conf.getAll.items() if before.get(k) != v}
    assert set(changed) <= {"spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"} and changed.get("spark.sql.execution.arrow.maxRecordsPerBatch") in (None, "1000")


def test_a_reader_holds_one_frame():
    import io

    from tesselode.llm.warc import read_stream

    class Counted(io.BytesIO):
        ahead = 0

        def read(self, n=-1):
            self.ahead += (x := len(out := super().read(n)))
            return out if x else b""

    data = archive(*[record(i, "http://x", bytes([65 + i % 20]) * 10 + str(i * 7919).encode() * 40_000, None, False) for i in range(20)])
    f, seen = Counted(data), 0
    for r in read_stream(f):
        assert _payload_number(r["payload"]) == seen * 7919
        seen += 1
        assert f.ahead <= len(data) * (seen + 1) // 20 + (2 << 16)
    assert seen == 20


def _payload_number(payload):
    tail = payload[10:]
    n = next(k for k in range(1, 12) if tail == tail[:k] * (len(tail) // k))
    return int(tail[:n])
