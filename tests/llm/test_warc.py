import base64
import hashlib

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from riskframe.llm import warc
from riskframe.session import scratch_path
from tests.llm.tables import same

PAGES = "page_id long, url string, html string"


def rows_of():
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<p>{'x' * (i * 50)}</p>\r\n\r\nWARC/1.1 ü{i % 4}") for i in range(30)]
    rows += [(100 + i, None, rows[i % 5][2]) for i in range(20)] + [(200, "u r l\r\nX: y", None), (201, "", ""), (3, rows[3][1], rows[3][2])]
    return rows + [(300, "http://long", "é" * 400_000)]


def want(rows, least=0):
    first: dict = {}
    for i, _, html in rows:
        first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        revisit = len(body) >= least and first[html or ""] != i
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "revisit" if revisit else "response", first[html or ""] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 200])
def test_round_trip(spark, least):
    rows = rows_of()
    got = warc.archive_round_trip(spark.createDataFrame(rows, PAGES), least)
    assert sorted(map(tuple, got.collect()), key=repr) == want(rows, least)


def test_a_page_id_with_several_payloads(spark):
    rows = [(1, "a", "one"), (2, "b", "two"), (5, "c", "one"), (5, "d", "two"), (6, "e", "six"), (5, "f", "one"), (None, "g", "one")]
    got = warc.archive_round_trip(spark.createDataFrame(rows, PAGES))
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got.collect()), key=repr) == sorted(
        [(1, "response", None), (2, "response", None), (5, "revisit", 1), (5, "revisit", 2), (6, "response", None), (5, "revisit", 1), (None, "response", None)], key=repr
    )


def folder_of(spark):
    path = scratch_path(spark, "archives")
    return path if path.startswith("file:") else f"file://{path}"


def test_files_are_cut_and_payloads_kept(spark):
    rows, folder = rows_of(), folder_of(spark)
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    manifest = warc.write_archives(pages, folder, file_bytes=2000)
    assert manifest.count() > 5 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    back = warc.read_archives(manifest, folder).where("record_type = 'response'").collect()
    html = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(bytes(r.payload) == html[r.page_id] for r in back)
    files, root = pafs.FileSystem.from_uri(folder)
    name = manifest.first()["path"]
    with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
        assert all(m.startswith(b"WARC/1.1\r\n") for m in warc.members(stream, 7))


def test_broken_archives_are_errors(spark):
    folder = folder_of(spark)
    manifest = warc.write_archives(spark.createDataFrame(rows_of()[:5], PAGES).coalesce(1), folder)
    files, root = pafs.FileSystem.from_uri(folder)
    path = f"{root}/{manifest.first()['path']}"
    with files.open_input_stream(path, compression=None) as stream:
        data = stream.read()
    with files.open_output_stream(path, compression=None) as out:
        out.write(data[:-20])
    with pytest.raises(Exception, match="ends inside a member"):
        warc.read_archives(manifest, folder).collect()
    record = warc.record(1, "http://x", b"payload", None)
    member = next(warc.members(__import__("io").BytesIO(record)))
    with pytest.raises(ValueError, match="digest"):
        warc.parse(member.replace(b"payload\r\n", b"pAyload\r\n"))
    with pytest.raises(ValueError, match="framing"):
        warc.parse(member[:-1])


def test_empty_and_clashes(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).collect() == []
    plain = spark.createDataFrame(rows_of(), PAGES)
    more = plain.select("*", *[F.lit(1).alias(c) for c in ("payload", "refers_to", "sha", "size", "_page")])
    assert same(warc.archive_round_trip(plain), warc.archive_round_trip(more))
