"""WARC archives: written with revisit records, read back as a chunked record table."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import open_fs, shared_path, write_atomically
from .words import slices

VERSION = b"WARC/1.1"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed date of records whose table has no time column.
DATE = "2000-01-01T00:00:00Z"
CHUNK = 1 << 20
#: Bytes after which a task begins a new archive.
ARCHIVE_BYTES = 256 << 20


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


_WITH_PAGE, _WITHOUT = 0x7061676501, 0x7061676500


def record_id(page_id: int | None, payload_sha1: bytes) -> str:
    """A version 8 UUID that holds the page's id in its free bits; without an id, the start of the payload's digest."""
    value = (page_id if page_id is not None else int.from_bytes(payload_sha1[:8], "big")) % 2**64
    h = f"{_WITHOUT if page_id is None else _WITH_PAGE:010x}{value & 0xFF:02x}8000{1 << 63 | value >> 8:016x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def page_of(record: str | None) -> int | None:
    """The page id in a record id; null for a record without one."""
    if not record:
        return None
    h = record[len("<urn:uuid:") : -1].replace("-", "")
    if int(h[:10], 16) != _WITH_PAGE:
        return None
    value = (int(h[16:], 16) & ~(1 << 63)) << 8 | int(h[10:12], 16)
    return value - 2**64 if value >= 2**63 else value


def _head(fields: list[tuple[str, str]]) -> bytes:
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 1):
    """The gzip member of one record, in chunks: a response, or a revisit of the page ``refers_to``."""
    sha1 = hashlib.sha1(payload, usedforsecurity=False).digest()
    uri = "".join(c for c in (url or f"urn:page:{page_id}") if c > " ")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, sha1)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{base32_sha1(sha1)}")]
    if refers_to is None:
        fields.append(("Content-Type", "application/http; msgtype=response"))
        body = HTTP_HEAD
    else:
        fields += [("WARC-Refers-To", record_id(refers_to, b"")), ("WARC-Profile", IDENTICAL), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
        body, payload = HTTP_HEAD, b""
    fields.append(("Content-Length", str(len(body) + len(payload))))
    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
    yield gz.compress(_head(fields) + body)
    for at in range(0, len(payload), CHUNK):
        yield gz.compress(payload[at : at + CHUNK])
    yield gz.compress(b"\r\n\r\n") + gz.flush()


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row of ``pages(page_id, url, html)``; returns the manifest ``path, records``.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes, that of the largest ``page_id`` is the
    response.  Digests are grouped on narrow rows (with partial maxima, so a payload that a third of the pages share
    is no hot group); payloads are shuffled once, by page, into the tasks that write the archives.  A task begins a new
    archive after ``archive_bytes``, so that none grows with the input.
    """
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    base = base.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    narrow = base.where((F.octet_length("html") >= min_revisit_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    newest = narrow.groupBy("digest").agg(F.max("page_id").alias("of"), F.count("*").alias("n")).where("n > 1").select("digest", "of")
    again = narrow.join(newest, "digest").where("page_id <> of").select("page_id", "digest", F.col("of").alias("refers_to")).distinct()
    told = base.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def write(batches):
        from pyspark import TaskContext

        def records():
            for batch in batches:
                ids, urls, refers = (batch.column(k).to_pylist() for k in (0, 1, 3))
                texts = batch.column(2).cast(pa.binary())
                for i, j in slices(texts):
                    yield from zip(ids[i:j], urls[i:j], texts.slice(i, j - i).to_pylist(), refers[i:j], strict=True)

        source, number = records(), 0
        waiting = next(source, None)
        while waiting is not None:
            n = 0

            def fill(out):
                nonlocal n, waiting
                size = 0
                while waiting is not None and size < archive_bytes:
                    for part in record_bytes(*waiting):
                        out.write(part)
                        size += len(part)
                    n += 1
                    waiting = next(source, None)

            path = f"{folder}/{TaskContext.get().partitionId():06d}-{number:05d}.warc.gz"
            write_atomically(path, fill)
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})
            number += 1

    told.sortWithinPartitions("page_id").mapInArrow(write, "path string, records long").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _inflated(stream, size: int):
    """The plain bytes of concatenated gzip members, in bounded pieces."""
    gz, data = zlib.decompressobj(31), b""
    while True:
        data = data or stream.read(size)
        if not data:
            return
        out = gz.decompress(data, size)
        if out:
            yield out
        if gz.eof:
            data, gz = gz.unused_data, zlib.decompressobj(31)
        else:
            data = gz.unconsumed_tail


class _Source:
    """Reading by line and by bounded piece over an iterator of byte strings."""

    def __init__(self, pieces):
        self.pieces, self.buffer = pieces, b""

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.buffer += piece
        return True

    def head(self) -> bytes | None:
        """Up to and without the empty line; None at the end."""
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self.more():
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + 4 :]
        return out

    def take(self, most: int) -> bytes:
        while not self.buffer and self.more():
            pass
        out, self.buffer = self.buffer[:most], self.buffer[most:]
        return out


def read_chunks(stream, chunk: int = CHUNK):
    """Rows of the chunked record table of one archive, holding one chunk at a time.

    (record_id, record_type, target_uri, refers_to, chunk_no, chunk_offset, chunk, running_digest, payload_bytes,
    payload_digest, is_last): ``running_digest`` covers the payload up to and with the chunk, so that of the last
    chunk is the payload's; an empty payload is one empty chunk.  Lengths and digests declared by a revisit are kept.
    """
    source = _Source(_inflated(stream, 1 << 16))
    while (raw := source.head()) is not None:
        lines = raw.decode().split("\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left = int(fields["content-length"])
        if fields.get("content-type", "").startswith("application/http"):
            http = source.head()
            left -= len(http) + 4
        kind, rid, refers = fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to")
        declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        running, number, offset = hashlib.sha1(usedforsecurity=False), 0, 0
        while True:
            parts, size = [], 0
            while size < min(chunk, left):
                part = source.take(min(chunk, left) - size)
                if not part:
                    raise ValueError(f"archive ends inside record {rid}")
                parts.append(part)
                size += len(part)
            data = b"".join(parts)
            running.update(data)
            left -= size
            last = not left
            total = int(fields["x-payload-length"]) if kind == "revisit" and "x-payload-length" in fields else offset + size
            digest = declared if kind == "revisit" else base32_sha1(running.digest())
            yield rid, kind, fields.get("warc-target-uri"), refers, number, offset, data, base32_sha1(running.digest()), total if last else None, digest if last else None, last, declared == digest if last else None
            number, offset = number + 1, offset + size
            if last:
                break
        source.head()  # the empty lines after the block


CHUNK_TABLE = "page_id long, record_id string, record_type string, target_uri string, refers_to long, chunk_no long, chunk_offset long, chunk binary, running_digest string, payload_bytes long, payload_digest string, is_last boolean, digest_ok boolean, archive string, record_no long"


def read_archives(manifest: DataFrame, with_chunks: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table (CHUNK_TABLE) of the archives of a manifest; an archive is streamed by one task.

    ``archive, record_no`` tell records apart that repeat an id.
    With ``with_chunks=False`` only the last row of each record is kept, without its bytes: whole-payload lengths and
    digests at no cost in memory or transfer.
    """

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = open_fs(path)
                rows, size, number = [], 0, -1
                with system.open_input_stream(name, compression=None) as stream:
                    for r in read_chunks(stream, chunk):
                        number += r[4] == 0
                        if not with_chunks and not r[10]:
                            continue
                        rows.append((page_of(r[0]), *r[:3], page_of(r[3]), *r[4:6], r[6] if with_chunks else None, *r[7:], path, number))
                        size += len(r[6]) if with_chunks else 256
                        if size >= 8 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    spread = manifest.select("path")
    return spread.repartition(max(1, spread.count())).mapInArrow(read, CHUNK_TABLE)


_KINDS = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.int64())
_NAMES = [x.split()[0] for x in CHUNK_TABLE.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives, read them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Cases: a null html is an empty payload (empty payloads are equal, too); a null url gets a urn of the page; rows
    that repeat a page id and payload are written each, all with the type of that id; a null ``page_id`` is always a
    response and comes back null; other columns are dropped; an empty table writes nothing and gives an empty result.
    """
    return whole_records(read_archives(write_archives(pages, min_revisit_bytes)))


def whole_records(chunks: DataFrame) -> DataFrame:
    """Records put together from the rows of their chunks: ``page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok``.

    A response's length is the sum over its chunks and its digest the running one of the last; a revisit's are those
    it declares.  A missing chunk is an error.  Chunks' bytes stay where they are read: only lengths are shuffled.
    """
    sized = chunks.withColumn("size", F.octet_length("chunk")).drop("chunk")
    last = lambda c: F.max_by(c, "chunk_no").alias(c)
    by = sized.groupBy("archive", "record_no").agg(F.count("*").alias("n"), F.max("chunk_no").alias("top"), F.sum("size").alias("size"), *[last(c) for c in ("record_id", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "running_digest", "is_last", "digest_ok")])
    answer = F.col("record_type") != "revisit"
    size = F.when((F.col("n") != F.col("top") + 1) | ~F.col("is_last"), F.raise_error(F.concat(F.lit("missing chunk of record "), "record_id")).cast("long")).when(answer, F.col("size")).otherwise(F.col("payload_bytes"))
    digest = F.when(answer, F.col("running_digest")).otherwise(F.col("payload_digest"))
    return by.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", "digest_ok")
