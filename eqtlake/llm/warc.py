"""WARC archives: a writer, a normaliser of monolithic gzip streams, a reader.

A monolithic archive is one gzip stream over all records, so nothing in it can be
read without inflating what is before. The normaliser inflates it once, in
chunks, rewrites every record as a gzip member of its own and writes a sidecar
index of offsets; the reader then seeks to single records.

Files lie in the shared folder and are reached through pyarrow's file systems.
They are written under a name of the attempt and renamed when complete, so a task
that is run again after a lost executor leaves the same file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eqtlake.plans.workspace import scratch_path

from .common import materialize, small_side

#: Payloads below this size are never written as revisits.
MIN_REVISIT = 1000
#: An archive is closed once its records have so many bytes.
ARCHIVE_BYTES = 1 << 30
CHUNK = 1 << 20
# WARC 1.1 names.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("/"):
        uri = f"file://{uri}"
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *[f"{k}: {v}".encode() for k, v in headers], f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0][:5] != b"WARC/":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = dict(line.decode().split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def page_record(page_id, url: str | None, payload: bytes, kind: str, refers_to, serial: str = "") -> bytes:
    """A record of one page. The page's id and its payload's full size are kept
    in extension headers; a revisit has no payload of its own. ``serial`` tells
    repeated rows apart."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{serial}:{target}:{digest}')}>"),
        ("WARC-Date", NO_DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if kind == "revisit":
        headers += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", str(refers_to))]
        payload = b""
    return record_bytes(headers, payload)


def _publish(system: pafs.FileSystem, made: str, name: str) -> None:
    """Rename a complete file; another attempt may have left the same one."""
    try:
        system.move(made, name)
    except OSError:
        if system.get_file_info(name).type != pafs.FileType.File:
            raise
        system.delete_file(made)


def write_monolithic(folder: str, limit: int = ARCHIVE_BYTES):
    """Task function: the records of the partition in archives of about ``limit``
    bytes before compression, each one gzip stream."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, root = _fs(folder)
        system.create_dir(root, recursive=True)
        rows = (row for batch in stream for row in batch.to_pylist())
        held = next(rows, None)
        number = 0
        while held is not None:
            name = f"{root}/mono-{context.partitionId():06d}-{number:06d}.warc.gz"
            attempt = f"{name}.{context.taskAttemptId()}.tmp"
            gzip, n, size = zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
            with system.open_output_stream(attempt, compression=None) as out:
                while held is not None and size < limit:
                    serial = f"{context.partitionId()}.{number}.{n}"
                    data = page_record(
                        held["page_id"], held["url"], held["payload"], held["record_type"], held["refers_to"], serial
                    )
                    out.write(gzip.compress(data))
                    n, size, held = n + 1, size + len(data), next(rows, None)
                out.write(gzip.flush())
            _publish(system, attempt, name)
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]]), pa.array([n])], names=["archive", "n"])

    return run


def inflated(source) -> Iterator[bytes]:
    """Chunks of a gzip file of one member or many."""
    gunzip = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            out = gunzip.decompress(data, CHUNK)
            if out:
                yield out
            data = gunzip.unconsumed_tail
            if gunzip.eof:
                data = gunzip.unused_data
                gunzip = zlib.decompressobj(31)
    if out := gunzip.flush():
        yield out


def records(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream; memory holds one record at a time."""
    held, chunks = bytearray(), iter(chunks)

    def fill() -> bool:
        more = next(chunks, None)
        if more is None:
            return False
        held.extend(more)
        return True

    while held or fill():
        begin = 0
        while (end := held.find(b"\r\n\r\n", begin)) < 0:
            begin = max(0, len(held) - 3)
            if not fill():
                raise ValueError("the archive ends inside a record's header")
        length = 0
        for line in bytes(held[:end]).split(b"\r\n"):
            if line.lower().startswith(b"content-length:"):
                length = int(line.split(b":", 1)[1])
        whole = end + 4 + length + 4
        while len(held) < whole:
            if not fill():
                raise ValueError("the archive ends inside a record")
        yield bytes(held[:whole])
        del held[:whole]


def normalise_archive(system: pafs.FileSystem, source: str, target: str, index: str) -> int:
    """Rewrite ``source`` with a member for each record, and its offset index: a
    JSON line with offset, length, type and id of each."""
    offset = n = 0
    with (
        system.open_input_stream(source, compression=None) as read,
        system.open_output_stream(target, compression=None) as out,
        system.open_output_stream(index, compression=None) as sidecar,
    ):
        for record in records(inflated(read)):
            member = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = member.compress(record) + member.flush()
            headers, _ = parse_record(record)
            line = {"offset": offset, "length": len(data), "type": headers["WARC-Type"], "id": headers["WARC-Record-ID"]}
            out.write(data)
            sidecar.write(json.dumps(line).encode() + b"\n")
            offset += len(data)
            n += 1
    return n


def normalise(folder: str):
    """Task function: normalise each archive named in the rows."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _fs(folder)
        attempt = TaskContext.get().taskAttemptId()
        for batch in stream:
            for name in batch.column("archive").to_pylist():
                done = name.replace("mono-", "part-")
                target, index = f"{root}/{done}", f"{root}/{done}.idx"
                n = normalise_archive(system, f"{root}/{name}", f"{target}.{attempt}.tmp", f"{index}.{attempt}.tmp")
                _publish(system, f"{target}.{attempt}.tmp", target)
                _publish(system, f"{index}.{attempt}.tmp", index)
                yield pa.RecordBatch.from_arrays([pa.array([done]), pa.array([n])], names=["archive", "n"])

    return run


def read_member(source, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    source.seek(offset)
    return parse_record(zlib.decompress(source.read(length), 31))


def read_back(folder: str):
    """Task function: the records of each normalised archive, by its index."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _fs(folder)
        for batch in stream:
            for name in batch.column("archive").to_pylist():
                with system.open_input_stream(f"{root}/{name}.idx", compression=None) as sidecar:
                    lines = sidecar.read().splitlines()
                with system.open_input_file(f"{root}/{name}") as source:
                    for i in range(0, len(lines), 200):
                        yield _rows(source, map(json.loads, lines[i : i + 200]))

    return run


_RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def _rows(source, lines: Iterable[dict]) -> pa.RecordBatch:
    rows = []
    for line in lines:
        headers, block = read_member(source, line["offset"], line["length"])
        digest = base64.b32decode(headers["WARC-Payload-Digest"].split(":")[1]).hex()
        size, kind = int(headers["X-Payload-Length"]), headers["WARC-Type"]
        if kind == "response" and (len(block) != size or hashlib.sha1(block).hexdigest() != digest):
            raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
        number = [int(x) if (x := headers.get(k)) is not None else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")]
        rows.append((number[0], headers["WARC-Target-URI"], size, digest, kind, number[1], block))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD
    )


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, record_type, refers_to) of (page_id, url, html).

    Of equal payloads of at least MIN_REVISIT bytes the one with the largest
    page_id is a response and others revisit it. The groups are made of digests
    and combined before the shuffle.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    digest = F.when(F.length("payload") >= MIN_REVISIT, F.sha1("payload"))
    groups = materialize(
        rows.select("page_id", digest.alias("g_digest"))
        .where("g_digest is not null and page_id is not null")
        .groupBy("g_digest")
        .agg(F.max("page_id").alias("last"), F.min("page_id").alias("first"))
        .where("first < last")
        .select("g_digest", "last"),
        "warc-groups",
    )
    # Small payloads have keys of their own, which match nothing and spread evenly.
    keyed = rows.withColumn("key", F.coalesce(digest, F.concat_ws(":", F.lit("none"), "page_id", F.xxhash64("url").cast("string"))))
    revisit = F.col("page_id") < F.col("last")
    return keyed.join(small_side(groups), F.col("key") == F.col("g_digest"), "left").select(
        "page_id",
        "url",
        "payload",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("last")).alias("refers_to"),
    )


def _dealt(archives: DataFrame) -> DataFrame:
    """About one archive a task, by name: hashes would give some tasks several."""
    return archives.repartitionByRange(max(1, archives.count()), "archive")


def write_archives(pages: DataFrame, folder: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write and normalise archives of ``pages`` in ``folder``; (archive, n)."""
    made = materialize(plan_records(pages).mapInArrow(write_monolithic(folder, limit), "archive string, n long"), "warc-mono")
    return materialize(_dealt(made).mapInArrow(normalise(folder), "archive string, n long"), "warc-parts")


def read_archives(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """Records of normalised archives: page_id, url, payload_bytes,
    payload_digest (hex SHA-1), record_type, refers_to, payload (empty for
    revisits). Sizes and digests are of the full payload; those of responses are
    checked against what is read."""
    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, payload binary"
    )
    return _dealt(archives).mapInArrow(read_back(folder), schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` and read the archives back.

    A null html is an empty payload. Rows with a null page_id are responses and
    nothing revisits them. Of repeated page ids with equal payloads, all rows of
    the largest id are responses. A null url is an empty one; line breaks in it
    are percent-encoded. Columns besides page_id, url and html are ignored. An
    empty table writes no archive and gives an empty result.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    return read_archives(spark, write_archives(pages, folder), folder)
