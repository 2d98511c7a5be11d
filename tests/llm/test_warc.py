import base64
import hashlib
import os

import pyarrow.fs as pafs
import pytest
import zstandard

from aislelens.llm import warc
from aislelens.session import scratch_path

from . import cases

SCHEMA = "page_id long, url string, html string, rid string, digest string, bytes string"


def pages():
    big = "<p>" + "long " * 40_000
    out = [(5, "u\r\nx: y", big), (3, None, None), (None, "z", ""), (4, "q", big), (2, "é", "ü" * 9), (2, "é", "ü" * 9),
           (None, "n", "only"), (7, "http://a/b", "\r\n\r\nContent-Length: 3\r\n")]
    out += [(100 + k, f"http://x/{k}", f"<html><body><p>{cases.prose(k, 60)}</body>") for k in range(40)]
    return [p + ("a", "b", "c") for p in out]


def test_round_trip(spark):
    folder = scratch_path(spark, "warc")
    files = warc.write(spark.createDataFrame(pages(), SCHEMA).repartition(3), folder)
    rows = warc.read(files).collect()
    assert len(rows) == len(pages())
    first = {}
    for p in sorted(pages(), key=lambda p: (p[0] is None, p[0] or 0)):
        first.setdefault(p[2] or "", p[0])
    want = []
    for k in first:
        same = [p for p in pages() if (p[2] or "") == k]
        lead = next(p for p in same if p[0] == first[k])
        data = k.encode()
        for p in same:
            role = ("response", None) if p is lead else ("revisit", first[k])
            want.append((p[0], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *role))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(map(cases.key, got)) == sorted(map(cases.key, want))
    assert {r.html for r in rows if r.html is not None} == set(first)


def test_leading_frame_holds_the_dictionary(spark):
    files = warc.write(spark.createDataFrame(pages(), SCHEMA), scratch_path(spark, "warc")).collect()
    fs, at = pafs.FileSystem.from_uri(files[0].path)
    data = fs.open_input_file(at).read()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    size = int.from_bytes(data[4:8], "little")
    known = zstandard.ZstdCompressionDict(data[8:8 + size])
    one = zstandard.ZstdDecompressor(dict_data=known).decompressobj().decompress(data[8 + size:])
    assert one.startswith(b"WARC/1.1\r\n") and one.count(b"WARC/1.1\r\n") == 1  # a record is a frame of its own
    assert not [f for f in os.listdir(os.path.dirname(at)) if not f.endswith((".warc.zst", ".crc"))]


@pytest.mark.parametrize("html", ["<p>one page and another", "x" * 100_000])
def test_few_or_large_records_have_a_dictionary_too(spark, html):
    """Too few for the trainer, or too large for its sample: their own bytes serve."""
    rows = [(k, f"https://example.org/{k}", f"{html} {k}") for k in range(3)]
    files = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), scratch_path(spark, "warc"))
    fs, at = pafs.FileSystem.from_uri(files.first().path)
    data = fs.open_input_file(at).read()
    size = int.from_bytes(data[4:8], "little")
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC and b"WARC" in data[8:8 + size]
    assert sorted((r.page_id, r.html) for r in warc.read(files).collect()) == [(r[0], r[2]) for r in rows]


def test_small_payloads_stay_responses(spark):
    files = warc.write(spark.createDataFrame(pages(), SCHEMA), scratch_path(spark, "warc"), least_bytes=100)
    rows = warc.read(files).collect()
    assert {r.record_type for r in rows if r.payload_bytes < 100} == {"response"}
    assert {r.page_id for r in rows if r.record_type == "revisit"} == {5}


def test_empty(spark):
    assert warc.read(warc.write(spark.createDataFrame([], SCHEMA), scratch_path(spark, "warc"))).count() == 0
