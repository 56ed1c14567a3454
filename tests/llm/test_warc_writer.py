import base64
import hashlib
import struct

import pytest
import zstandard
from pyarrow.fs import FileSystem

from tidewire.llm import warc_writer

SCHEMA = "page_id long, url string, html string, records string, path string, digest string"


def _pages():
    rows = [(k, f"http://e.x/{k} ü\n", f"<p>page {k % 40}</p>" * (1 + k % 40)) for k in range(200)]
    return rows + [(500, None, None), (501, "u", ""), (None, "u", "<p>page 1</p><p>page 1</p>"), (502, "big", "z\r\n\r\nWARC/1.1" * 30_000), (199, rows[199][1], rows[199][2])]


def _want(rows, least=0):
    best = {}
    for i, _, h in rows:
        p = (h or "").encode()
        best[p] = max(best.get(p, -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = i is not None and i < best[p] and len(p) >= least
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", best[p] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "size"), [(0, 4000), (100, 1 << 25)])
def test_round_trip(spark, least, size):
    rows = _pages()
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    manifest = warc_writer.write(df, least_bytes=least, archive_bytes=size)
    got = warc_writer.read(manifest, with_payload=True).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == _want(rows, least)
    payloads = {r["page_id"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    assert all(payloads[i] == (h or "").encode() for i, _, h in rows if i in payloads)
    assert sum(r["records"] for r in manifest.collect()) == len(rows)


def test_archive_has_a_leading_dictionary_and_single_frames(spark):
    rows = [(k, f"http://e.x/{k}", "<html><body>" + f"<p>words of page {k} and more {k * 7}</p>" * 20) for k in range(300)]
    manifest = warc_writer.write(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).coalesce(1))
    path = manifest.collect()[0]["path"]
    system, base = FileSystem.from_uri(path)
    content = system.open_input_stream(base).read()
    magic, size = struct.unpack_from("<II", content)
    assert magic == 0x184D2A5D and struct.unpack_from("<I", content, 8)[0] == 0xEC30A437
    records = list(warc_writer.frames(content))
    assert len(records) == 300 and all(r.startswith(b"WARC/1.1\r\n") for r in records)
    bare = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(content) < bare
    assert {warc_writer.parse(r)["page-id"] for r in records} == {str(k) for k in range(300)}


def test_few_records_need_no_dictionary():
    assert list(warc_writer.frames(warc_writer.archive([b"a", b"b" * 100_000]))) == [b"a", b"b" * 100_000]
    with pytest.raises(ValueError):
        list(warc_writer.frames(warc_writer.archive([b"abc" * 100])[:-3]))


def test_empty(spark):
    assert warc_writer.read(warc_writer.write(spark.createDataFrame([], SCHEMA))).count() == 0
