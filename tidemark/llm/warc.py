"""WARC archives: writing whole-file gzip streams, normalising them to a member for each record with an offset index, reading.

Archives live in the folder all executors share and are reached through pyarrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shared_dir, stored

#: Payloads below this are never revisits.
LEAST_REVISIT = 100
#: A writer begins a new archive beyond so many uncompressed bytes: an archive is one stream, so one task's work.
ARCHIVE_BYTES = 1 << 28
#: Records of an archive that one task reads.
READ_RECORDS = 4096
#: Bytes that are inflated or read at once.
CHUNK = 1 << 20
LEVEL = 4

INDEX = "archive string, record_id string, record_type string, position long, size long"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header alone, which states the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').translate({13: None, 10: None})}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields (lower case) and block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file, one member or many, in chunks."""
    machine = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            yield machine.decompress(data)
            data = machine.unused_data
            if machine.eof:
                machine = zlib.decompressobj(31)


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream; holds one record and a chunk."""
    kept = bytearray()
    for more in chunks:
        kept += more
        while (cut := kept.find(b"\r\n\r\n")) >= 0:
            fields = kept[:cut].lower()
            at = fields.find(b"\r\ncontent-length:")
            size = cut + 4 + int(fields[at + 17 :].split(b"\r\n", 1)[0]) + 4
            if len(kept) < size:
                break
            yield bytes(kept[:size])
            del kept[:size]
    if kept.strip():
        raise ValueError("an archive ends within a record")


def _member(data: bytes) -> bytes:
    machine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return machine.compress(data) + machine.flush()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes each partition's pages (page_id, url, html, digest, refers_to) as archives of one gzip stream each.

    Returns (archive, records). A task that runs again writes other files, and only those it reports are read.
    """

    def run(batches):
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        out, sink, machine = [], None, None
        size = count = 0
        path = ""

        def close():
            sink.write(machine.flush())
            sink.close()
            out.append((f"{folder}/{path}", count))

        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if sink is None or size > ARCHIVE_BYTES:
                    if sink is not None:
                        close()
                    path = f"{uuid.uuid4().hex}.whole.warc.gz"
                    sink, machine = system.open_output_stream(f"{base}/{path}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    size = count = 0
                data = record(page_id, url, (html or "").encode("utf-8", "replace"), digest, refers)
                sink.write(machine.compress(data))
                size, count = size + len(data), count + 1
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=["archive", "records"])

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "archive string, records long")


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrites each archive with one gzip member a record, writes its index beside it, and returns the index.

    Each archive is inflated once, as a stream, in a task of its own.
    """
    names = [x.split(" ")[0] for x in INDEX.split(", ")]

    def run(batches):
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                system, path = _open(source)
                name = f"{source.removesuffix('.whole.warc.gz').removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
                target = _open(name)[1]
                rows, position = [], 0
                with system.open_input_stream(path, compression=None) as f, system.open_output_stream(target, compression=None) as g:
                    for data in records(inflated(f)):
                        fields, _ = parse(data)
                        g.write(member := _member(data))
                        rows.append((name, fields["warc-record-id"], fields["warc-type"], position, len(member)))
                        position += len(member)
                with system.open_output_stream(f"{target}.index", compression=None) as g:
                    g.write("".join(f"{i}\t{t}\t{p}\t{n}\n" for _, i, t, p, n in rows).encode())
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k : k + 10_000], strict=True)], names=names)

    return dealt(archives.select("archive"), archives.count()).mapInArrow(run, INDEX)


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """rows in so many partitions, which adaptive execution doesn't put together again: a row here stands for much work."""
    return rows.repartition(max(1, parts))


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index names, each inflated from its own member: PAGE, in any order."""
    names = [x.split(" ")[0] for x in PAGE.split(", ")]

    def number(x: str) -> int | None:
        x = x.rpartition(":")[2].rstrip(">")
        return int(x) if x else None


    def run(batches):
        handle, now = None, None
        for batch in batches:
            rows = []
            for archive, position, size in zip(*(batch.column(c).to_pylist() for c in ("archive", "position", "size")), strict=True):
                if archive != now:
                    system, path = _open(archive)
                    handle, now = io.BufferedReader(system.open_input_file(path), CHUNK), archive
                handle.seek(position)
                fields, block = parse(zlib.decompress(handle.read(size), 31))
                head, _, payload = block.partition(b"\r\n\r\n")
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                if fields["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{fields['warc-record-id']}: the payload doesn't match its digest")
                length = int(head.lower().partition(b"content-length:")[2].split(b"\r\n", 1)[0])
                refers = number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
                rows.append((number(fields["warc-record-id"]), length, digest, fields["warc-type"], refers))
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    spans = Window.partitionBy("archive").orderBy("position")
    parts = index.select("archive", "position", "size").withColumn("part", F.floor(F.row_number().over(spans) / READ_RECORDS))
    number_of_parts = parts.select("archive", "part").distinct().count()
    return parts.repartition(max(1, number_of_parts), "archive", "part").sortWithinPartitions("archive", "position").select("archive", "position", "size").mapInArrow(run, PAGE)


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages with `digest` and `refers_to`: of equal payloads of LEAST_REVISIT bytes or more, the first page_id of all others.

    Pages without page_id revisit the first that has one; where none has, all are responses. So are rows that repeat the first page_id.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    pages = pages.withColumns({"digest": F.sha2(payload, 256), "_size": F.octet_length(payload)})
    known = pages.where(F.col("_size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    known = stored(known.where("_n > 1").select("digest", "_first"), "payloads")  # so Spark knows its size, and moves html only if it must
    found = pages.join(known, "digest", "left")
    return found.withColumn("refers_to", F.when(~F.col("_first").eqNullSafe(F.col("page_id")), F.col("_first"))).drop("_first", "_size", "_n")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, these normalised, and read back by their index. Null html is an empty payload.

    Pages without page_id, and repeated page_ids, each have their record and row.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    folder = shared_dir(spark, "warc")
    archives = stored(write(with_revisits(pages), folder), "archives")
    return read(stored(normalise(archives), "index"), folder)
