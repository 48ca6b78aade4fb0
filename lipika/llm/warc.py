"""WARC archives: writing, normalising whole-file gzip streams, and reading by offset.

Some writers compress a whole archive as one gzip stream, from which no record can be read
without inflating all before it. :func:`normalise` inflates such a stream once, writes every
record again as a gzip member of its own, and writes a sidecar index (offset, length, type and
record id of each member). Memory is bounded by the largest record.

Pages with equal payloads: the one with the largest id is stored as ``response``; the others
are ``revisit`` records that refer to it and have no payload, only its digest and length.

Defined results: a null html is an empty payload. A null page id gets a record id that no page
has and comes back as null; it never is the page that others refer to. Rows that repeat the
largest id are all ``response``. Null urls are left out of the record; white space in one is percent-encoded. Empty tables give no files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote
from uuid import UUID

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipika.llm.files import delete, opened, replacing
from lipika.session import scratch, written

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BUFFER = 1 << 20
_SPACES = re.compile(r"\s")
_NO_ID = 1 << 127
_GZIP = 16 + zlib.MAX_WBITS


def record_id(page_id: int | None) -> str:
    """The record's URN; the page's id is the low half of the UUID."""
    return f"<urn:uuid:{UUID(int=_NO_ID if page_id is None else page_id & (1 << 64) - 1)}>"


def page_of(record: str) -> int | None:
    n = UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    return None if n == _NO_ID else n - (1 << 64) if n >> 63 else n


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """The bytes of a response, or of a revisit where ``refers_to`` is given."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_SPACES.sub(lambda m: quote(m[0]), url)}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """Names in lower case; a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def inflated(stream) -> Iterator[bytes]:
    """Plain bytes of a gzip file of one member or many; zeros after a member are padding. A stream that is cut off or damaged raises ValueError."""
    engine, members, fed = zlib.decompressobj(_GZIP), 0, False
    while True:
        data = stream.read(_BUFFER)
        last = not data
        while data or (last and fed):
            if members and not fed:
                data = data.lstrip(b"\0")
                if not data:
                    break
            try:
                out = engine.decompress(data, _BUFFER)
            except zlib.error as e:
                raise ValueError(f"damaged gzip stream: {e}") from e
            fed = True
            if out:
                yield out
            if engine.eof:
                data, engine, members, fed = engine.unused_data, zlib.decompressobj(_GZIP), members + 1, False
            else:
                data = engine.unconsumed_tail
                if last and not out and not data:
                    raise ValueError("the gzip stream is cut off")
        if last:
            return


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a plain stream, cut by their content lengths."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while True:
            end = held.find(b"\r\n\r\n")
            if end < 0:
                break
            size = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < size:
                break
            yield bytes(held[:size])
            del held[:size]
    if held.strip():
        raise ValueError("the archive ends within a record")


def normalise(source: str, target: str, index: str, level: int = 6) -> int:
    """Rewrite one archive with a member for each record, and its sidecar index. Returns the number of records."""
    system, path = opened(source)
    n = at = 0
    with system.open_input_stream(path, compression=None) as stream, replacing(target) as out, replacing(index) as side:
        for raw in records(inflated(stream)):
            engine = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
            member = engine.compress(raw) + engine.flush()
            h = headers(raw[: raw.find(b"\r\n\r\n")])
            out.write(member)
            side.write((json.dumps([at, len(member), h["warc-type"], h["warc-record-id"]]) + "\n").encode())
            at += len(member)
            n += 1
    return n


def read_at(archive, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record headers, HTTP headers, payload) of the member at an offset."""
    raw = zlib.decompress(archive.read_at(length, offset), _GZIP)
    end = raw.find(b"\r\n\r\n")
    h = headers(raw[:end])
    block = raw[end + 4 : end + 4 + int(h["content-length"])]
    cut = block.find(b"\r\n\r\n")
    return h, headers(block[:cut]), block[cut + 4 :]


def with_revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``payload`` (string) and ``refers_to`` (null: a response)."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    base = base.withColumn("sha", F.unhex(F.sha1("payload")))
    shared = base.filter(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper"))
    joined = base.join(shared.filter("n > 1").select("sha", "keeper"), "sha", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("keeper"))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("keeper")).alias("refers_to"))


def write_monolithic(rows: DataFrame, folder: str) -> DataFrame:
    """One archive for each partition, compressed as a single stream; gives their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        path = f"{folder}/whole-{TaskContext.get().partitionId():06d}.warc.gz"
        engine = zlib.compressobj(1, zlib.DEFLATED, _GZIP)
        with replacing(path) as out:
            batch: pa.RecordBatch | None = first
            while batch is not None:
                for at in range(0, batch.num_rows, 200):
                    for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns)):
                        out.write(engine.compress(record(page, url, payload.encode(), refers)))
                batch = next(batches, None)
            out.write(engine.flush())
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    return rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string")


def one_each(archives: DataFrame) -> DataFrame:
    """The archives of a column ``path``, dealt one to a task."""
    return archives.repartitionByRange(max(1, archives.count()), "path")


def normalise_all(archives: DataFrame, keep_source: bool = True) -> DataFrame:
    """``path``, ``index`` and ``n`` of the normalised form of each archive of a column ``path``; it stands beside the source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                stem = source.removesuffix(".gz").removesuffix(".warc")
                target, index = f"{stem}.members.warc.gz", f"{stem}.members.idx"
                n = normalise(source, target, index)
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([index]), pa.array([n], pa.int64())], names=["path", "index", "n"])

    archives = one_each(archives)
    done = written(archives.select("path").mapInArrow(run, "path string, index string, n bigint"), "archives")
    if not keep_source:

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for source in batch.column(0).to_pylist():
                    delete(source)
                yield batch

        archives.select("path").mapInArrow(drop, "path string").count()
    return done


def read(archives: DataFrame) -> DataFrame:
    """A row for each record, read through the sidecar indexes; payload digests of responses are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, local = opened(index)
                with system.open_input_stream(local, compression=None) as f:
                    entries = [json.loads(line) for line in f.read().decode().splitlines()]
                system, local = opened(path)
                with system.open_input_file(local) as archive:
                    for at in range(0, len(entries), 200):
                        rows = []
                        for offset, length, kind, name in entries[at : at + 200]:
                            h, http, payload = read_at(archive, offset, length)
                            digest = h["warc-payload-digest"].removeprefix("sha1:")
                            if h["warc-record-id"] != name or kind == "response" and digest_of(payload) != digest:
                                raise ValueError(f"damaged record {name} in {path}")
                            refers = h.get("warc-refers-to")
                            rows.append((page_of(name), int(http["content-length"]), digest, kind, page_of(refers) if refers else None, h.get("warc-target-uri"), payload))
                        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return one_each(archives).select("path", "index").mapInArrow(
        run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"
    )


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder, normalise them, and give ``path``, ``index`` and ``n`` of each."""
    folder = scratch(pages.sparkSession, "warc")
    whole = written(write_monolithic(with_revisits(pages, least_bytes), folder), "whole")
    return normalise_all(whole, keep_source=False)
