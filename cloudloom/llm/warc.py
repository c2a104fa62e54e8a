"""WARC archives: writing, normalising monolithic gzip files, reading back by offset.

A crawler that compresses a whole archive as one gzip stream leaves a file that nothing can seek in. The normaliser
inflates such a stream once, piece by piece, writes every record as a gzip member of its own, and keeps a sidecar index of
(record, offset, length), by which single records are read again. It reads streams of several members, padded ones too.

Archives are rows of tables in the shared folder (name, bytes, and for normalised ones the index), bounded in size, so
Spark's own readers and writers move them and a task that is lost is simply run again. `normalise_files` streams .warc.gz files of
any size from stores that Arrow opens, and holds one record and one archive of ARCHIVE_BYTES at a time; `archives_of` reads files of
any store that Spark reads, but whole (a file is one value of at most 2 GB). `sidecar` makes a table of its own of the index.

Edge cases: a null or empty html is a record with an empty payload; payloads under `least` bytes are never revisits;
rows that repeat a page_id with an equal payload are all responses where that page_id is the smallest; a null page_id is kept, is written
as `-` and is larger than all others, so such a row revisits the smallest page_id that has its payload (all are responses where none has one); an empty table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, lean, small_batches, written

ARCHIVE_BYTES = 8_000_000  # of records in one archive, before compression
BROADCAST_ROWS = 100_000  # revisits that go to every executor, at most
LEVEL = 5
CRLF = b"\r\n"


def decisions(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that revisit an equal payload; narrow, and only for digests seen twice."""
    narrow = pages.select(F.col("page_id"), F.sha2(F.col("payload"), 256).alias("digest"), F.octet_length("payload").alias("n")).filter(F.col("n") >= least).drop("n")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1 and refers_to is not null").drop("copies")
    return narrow.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the headers of the full payload and no block."""
    name = "-" if page_id is None else str(page_id)
    block = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else " " for c in url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + CRLF * 2


def headers(data: bytes) -> dict[str, str]:
    """The named fields of a record, their names in lower case."""
    fields = (x.partition(":") for x in data.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, colon, value in fields if colon}


def records(data: bytes) -> Iterator[tuple[dict[str, str], int, int, int]]:
    """(headers, start, block start, end) of each record in inflated bytes."""
    at = 0
    while at < len(data):
        body = data.index(CRLF * 2, at) + 4
        head = headers(data[at:body])
        end = body + int(head["content-length"]) + 4
        yield head, at, body, end
        at = end


def _pack(records_of: list[bytes]) -> bytes:
    return zlib.compress(b"".join(records_of), LEVEL, 31)


def write_monolithic(pages: DataFrame, least: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(name, archive): whole-file gzip streams over all rows of pages(page_id, url, payload binary)."""
    marked = pages.withColumn("digest", F.sha2(F.col("payload"), 256))
    d = cut_lineage(decisions(pages, least).select(F.col("page_id").alias("d_id"), F.col("digest").alias("d_digest"), "refers_to"))
    d = F.broadcast(d) if d.count() <= BROADCAST_ROWS else d  # 100 bytes a row; with more rows the payloads are shuffled
    joined = marked.join(d, F.col("page_id").eqNullSafe(F.col("d_id")) & (F.col("digest") == F.col("d_digest")), "left").select("page_id", "url", "payload", "digest", "refers_to")

    @lean
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, run = [], 0, uuid.uuid4().hex

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([run]), pa.array([_pack(held)], pa.binary())], names=["name", "archive"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                held.append(record(*row))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield done()
                    held, size, run = [], 0, uuid.uuid4().hex
        if held:
            yield done()

    return joined.mapInArrow(write, "name string, archive binary")


def archives_of(spark: SparkSession, path: str) -> DataFrame:
    """(name, archive) of the files at path, monolithic or not."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), F.col("content").alias("archive"))


def sidecar(archives: DataFrame) -> DataFrame:
    """(name, record_id, at, length): the index of normalised archives as a table of its own."""
    return archives.select("name", F.explode("index").alias("x")).select("name", "x.record_id", "x.at", "x.length")


def inflated(raw: BinaryIO, piece: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip stream of any number of members, in pieces."""
    stream, fresh = zlib.decompressobj(31), True
    while part := raw.read(piece):
        while part:
            if fresh and not (part := part.lstrip(b"\0")):  # padding between members
                break
            fresh = False
            if out := stream.decompress(part, 4 * piece):
                yield out
            part = stream.unconsumed_tail
            if stream.eof:
                part, stream, fresh = stream.unused_data, zlib.decompressobj(31), True
    while not fresh and (out := stream.decompress(stream.unconsumed_tail, 4 * piece)):
        yield out
    if not fresh and not stream.eof:
        raise ValueError("the archive ends inside a gzip member")


def streamed(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, bytes) of each record of an inflated stream."""
    held, need = bytearray(), 0
    for piece in pieces:
        held += piece
        at = 0
        while len(held) - at >= need and (body := held.find(CRLF * 2, at)) >= 0:
            head = headers(bytes(held[at : body + 4]))
            need = body + 8 + int(head["content-length"]) - at
            if len(held) - at < need:
                break
            yield head, bytes(held[at : at + need])
            at, need = at + need, 0
        del held[:at]
    if held:
        raise ValueError("the archive ends inside a record")


INDEX = pa.list_(pa.struct([("record_id", pa.string()), ("at", pa.int64()), ("length", pa.int64())]))


NORMALISED = "name string, archive binary, index array<struct<record_id string, at long, length long>>"


def rewritten(name: str, raw: BinaryIO, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """The normalised archives of one stream, inflated once: every record as its own gzip member, and where each is."""
    members, index, at, size, part = [], [], 0, 0, 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"{name}.{part}"]), pa.array([b"".join(members)], pa.binary()), pa.array([index], INDEX)], names=["name", "archive", "index"])

    for head, record_ in streamed(inflated(raw)):
        members.append(zlib.compress(record_, LEVEL, 31))
        index.append({"record_id": head["warc-record-id"], "at": at, "length": len(members[-1])})
        at, size = at + len(members[-1]), size + len(record_)
        if size >= archive_bytes:
            yield done()
            members, index, at, size, part = [], [], 0, 0, part + 1
    if members:
        yield done()


def normalise(archives: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(name, archive, index) of archives(name, archive): a stream of more than archive_bytes gives several, with numbers behind its name."""

    @lean
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, archive in zip(b.column("name").to_pylist(), b.column("archive")):
                yield from rewritten(name, pa.BufferReader(archive.as_buffer()), archive_bytes)

    return archives.select("name", "archive").mapInArrow(rewrite, NORMALISED)


def normalise_files(spark: SparkSession, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """As normalise, of the files at path: Spark lists them, and a task streams its files one after another without holding one."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # no content is read for these
    count, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()

    @lean
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for name in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", name).replace(" ", "%20"))
                with store.open_input_stream(at, compression=None) as raw:
                    yield from rewritten(name, raw, archive_bytes)

    tasks = max(1, min(count, size // (64 << 20) + 1))
    return files.repartitionByRange(tasks, F.xxhash64("path")).select("path").mapInArrow(rewrite, NORMALISED)


def read_back(archives: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record, by the sidecar index.

    A response's length and digest are computed anew from its block, and must be those that its headers name, if they do.
    Records of other writers have no page_id, and any type that they say.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def number(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", urn or "")
        return int(found[1]) if found else None

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, index in zip(b.column("archive"), b.column("index").to_pylist()):
                raw, rows = archive.as_buffer(), []
                for entry in index:
                    data = zlib.decompress(raw.slice(entry["at"], entry["length"]), 31)
                    ((head, _, body, end),) = records(data)
                    kind, named, size = head.get("warc-type"), head.get("warc-payload-digest", ""), head.get("x-payload-length")
                    if head["warc-record-id"] != entry["record_id"]:
                        raise ValueError(f"the index names {entry['record_id']} where {head['warc-record-id']} is")
                    block = data[body : end - 4]
                    own = (hashlib.sha256(block).hexdigest(), len(block))
                    told = (named.removeprefix("sha256:") if named.startswith("sha256:") else own[0], own[1] if size is None else int(size))
                    if kind != "revisit" and own != told:
                        raise ValueError(f"{head['warc-record-id']}: the payload is not the one that was written")
                    rows.append((number(head["warc-record-id"]), head.get("warc-target-uri"), told[1], told[0], kind, number(head.get("warc-refers-to"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return archives.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """Write pages to monolithic archives, normalise these, and read the records back from the normalised ones."""
    rows = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    return read_back(written(normalise(written(write_monolithic(rows, least), "warc-monolithic")), "warc"))
