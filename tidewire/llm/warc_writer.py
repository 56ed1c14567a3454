"""WARC archives with a Zstandard dictionary: the dictionary, trained on the archive's own records, stands in a leading
skippable frame; every record is a frame of its own.

Of records with equal payloads the one with the largest page id is a response, the others are revisits without payload.
Checksums alone are shuffled to find them.  A task writes its records into archives of bounded size under names of
its own attempt; only archives of attempts that ended well stand in the stored manifest, so a task that is run again
leaves no record twice.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.storage import new_folder, stored

#: Skippable frame that holds a dictionary, and the magic number of Zstandard dictionaries. (fixed values)
DICTIONARY_FRAME, DICTIONARY_MAGIC = 0x184D2A5D, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 15


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(kind: str, page_id, url, digest: str, size: int, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC record; a revisit keeps the response's HTTP head, with the payload's full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def trained(records: list[bytes], dictionary_bytes: int, sample_bytes: int) -> bytes:
    """Dictionary of evenly spread records of together about ``sample_bytes``; empty if they are too few or too small."""
    total = sum(map(len, records))
    step = max(1, -(-total // sample_bytes))
    sample = [r[: 1 << 17] for r in records[::step]]
    if len(sample) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(dictionary_bytes, max(256, sum(map(len, sample)) // 10)), sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive(records: list[bytes], dictionary_bytes: int = 112_640, sample_bytes: int = 4 << 20, level: int = 3) -> bytes:
    dictionary = trained(records, dictionary_bytes, sample_bytes)
    out = [struct.pack("<II", DICTIONARY_FRAME, len(dictionary)), dictionary] if dictionary else []
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    pack = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=True)
    return b"".join([*out, *map(pack.compress, records)])


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    view, at, data = memoryview(content), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", view, 4)[0]
        raw, at = bytes(view[8 : 8 + size]), 8 + size
        if struct.unpack_from("<I", raw)[0] != DICTIONARY_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        data = zstandard.ZstdCompressionDict(raw)
    unpack = zstandard.ZstdDecompressor(dict_data=data) if data else zstandard.ZstdDecompressor()
    while at < len(view):
        one, out = unpack.decompressobj(), []
        while not one.eof:
            piece = view[at : at + READ_BYTES]
            if not piece:
                raise ValueError("archive ends within a record")
            out.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    """Headers (lower-case names) of a record, its ``payload`` and the payload's full length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    return fields | {"payload": payload, "payload_bytes": full}


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id``, ``digest`` (hex SHA-1) and ``refers_to`` of pages whose payload a page of larger id holds too."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sums = pages.select("page_id", F.sha1(payload).alias("digest"), F.length(payload).alias("size")).filter(F.col("size") >= least_bytes)
    largest = sums.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"))
    return sums.join(largest, ["digest", "size"]).filter("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = 32 << 20, date: str = "2000-01-01T00:00:00Z", folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) and return the stored manifest: ``path``, ``records``, ``raw_bytes``, ``bytes``.

    A null html is an empty payload.  Pages without id are responses without a page id.  Repeated rows of the largest
    id are responses each; a null url is left out.  A record longer than ``archive_bytes`` has an archive of its own.
    Other columns are ignored; an empty table writes nothing.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    rows = rows.join(revisits(pages, least_bytes), ["page_id", "digest"], "left")
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), F.octet_length("html").alias("size"), "digest", "refers_to")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        task, held, size, number = TaskContext.get(), [], 0, 0

        def close() -> pa.RecordBatch:
            content = archive(held)
            name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{number:05d}.warc.zst"
            with system.open_output_stream(f"{base}/{name}") as out:
                out.write(content)
            return pa.record_batch([[f"{folder}/{name}"], [len(held)], [size], [len(content)]], ["path", "records", "raw_bytes", "bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, text, full, digest, refers_to = (c[i].as_py() for c in batch.columns)
                b32 = base64.b32encode(bytes.fromhex(digest)).decode()
                payload = text.encode() if text is not None else b""
                held.append(record("response" if refers_to is None else "revisit", page_id, url, b32, full, payload, refers_to, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    return stored(rows.mapInArrow(put, "path string, records long, raw_bytes long, bytes long"), "manifest")


def read(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the archives: ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``
    and, on demand, ``payload``.  A payload that differs from its digest raises ValueError."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, base = FileSystem.from_uri(path)
                with system.open_input_stream(base) as source:
                    content = source.read()
                rows = []
                for raw in frames(content):
                    x = parse(raw)
                    digest, kind = x["warc-payload-digest"].removeprefix("sha1:"), x["warc-type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(x["payload"]).digest()).decode() != digest:
                        raise ValueError(f"damaged payload in {path}")
                    ids = [int(x[k]) if k in x else None for k in ("page-id", "refers-to-page-id")]
                    rows.append((ids[0], x.get("warc-target-uri"), x["payload_bytes"], digest, kind, ids[1], x["payload"])[: len(names)])
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names)

    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.select("path").repartition(spread, "path").mapInArrow(get, schema + (", payload binary" if with_payload else ""))
