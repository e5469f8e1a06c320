"""WARC archives: one gzip member per record, written and read back by Spark tasks.

Writing: each task streams its pages into archive files in the shared folder, a new file when one is full, under names
that no other attempt uses.  The manifest (file, records, bytes) is written when the tasks are done and names the files
of successful attempts only, so files of lost attempts are never read.  Of records with equal payloads the one with the
smallest page_id is the response; the others are revisit records that refer to it and carry no payload.

Reading: a task reads a file from its start in small blocks.  Every record is a gzip member of its own, inflated as it
comes; its block is cut out by content length, and the digest of each response is checked.  A broken file is an error.

A null html is an empty payload, a null url an empty target.  Rows that share the smallest page_id of a payload are all
responses; a page_id that comes with several payloads has a record for each, referring to the first page of that payload.
A record is put together in memory, payloads of any length included.  An empty table gives an empty manifest and no records.
Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import written
from riskframe.session import scratch_path

#: Size of an archive file at which the next one starts; bytes read at once.
FILE_BYTES, BLOCK = 64 << 20, 1 << 18
STAMP = "1970-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def first_pages(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, sha, size, refers_to) of the payloads of pages that an earlier page holds."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(body).alias("sha"), F.octet_length(body).alias("size"))
    keys = keys.where(F.col("size") >= least_bytes)
    first = keys.groupBy("sha", "size").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keys.join(first, ["sha", "size"]).where("page_id <> refers_to").select("page_id", "sha", "size", "refers_to").distinct()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Date: {STAMP}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the pages' records below ``folder`` (any address that pyarrow opens); the manifest as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out, path, count, size, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, count, size = f"{root.rstrip('/')}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(path, compression=None)
                member = record(page_id, url, payload, refers_to)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= file_bytes:
                    out.close()
                    done.append((path.rpartition("/")[2], count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path.rpartition("/")[2], count, size))
        if done:
            names, counts, sizes = zip(*done)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"]
            )

    later = first_pages(pages, least_bytes)
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), body.alias("payload"))
    # a page_id may come with several payloads: each meets the first page of its own
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    rows = rows.join(later, ["page_id", "sha", "size"], "left").select("page_id", "url", "payload", "refers_to")
    return written(rows.mapInArrow(run, MANIFEST), "manifest")


def members(stream, block: int = BLOCK) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one after the other."""
    rest = stream.read(block)
    while rest:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not rest:
                raise ValueError("the archive ends inside a member")
            parts.append(inflate.decompress(rest))
            rest = inflate.unused_data if inflate.eof else stream.read(block)
        yield b"".join(parts)
        rest = rest or stream.read(block)


def parse(member: bytes) -> tuple:
    """A row of RECORDS from one record; its framing and, for a response, its digest are checked."""
    head, _, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    size = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"bad framing of record {fields.get('WARC-Record-ID')}")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind, payload = fields["WARC-Type"], None
    if kind == "response":
        payload = rest[:size].partition(b"\r\n\r\n")[2]
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"bad digest of record {fields['WARC-Record-ID']}")
    whole = lambda name: int(fields[name]) if fields.get(name) else None
    return whole("X-Page-ID"), fields["WARC-Target-URI"], kind, whole("X-Refers-To-Page-ID"), digest, None if payload is None else len(payload), payload


def read_archives(manifest: DataFrame, folder: str, rows_at_once: int = 200) -> DataFrame:
    """The records of the archives that the manifest names."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, held = 0, []
                with files.open_input_stream(f"{root.rstrip('/')}/{name}", compression=None) as stream:
                    for member in members(stream):
                        held.append(parse(member))
                        found += 1
                        if len(held) >= rows_at_once:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
                            held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
                if found != expected:
                    raise ValueError(f"{name} holds {found} records, the manifest says {expected}")

    files = manifest.count()
    return manifest.repartition(max(1, files), "path").select("path", "records").mapInArrow(run, RECORDS)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write every page, read the archives back, and give each revisit the size of the payload it stands for."""
    folder = scratch_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("file:/") else f"file://{folder}"
    back = written(read_archives(write_archives(pages, folder, least_bytes), folder).drop("payload", "url"), "records")
    sizes = back.where("record_type = 'response'").select("payload_digest", "payload_bytes").distinct().toDF("payload_digest", "size")
    return back.join(sizes, "payload_digest", "left").select(
        "page_id", F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
