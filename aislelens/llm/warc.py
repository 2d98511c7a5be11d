"""WARC (operator 6): dictionary-compressed writer, and its reader.

Each task writes one ``.warc.zst`` file: a leading skippable frame holds the Zstandard dictionary, then each record
is a frame of its own (compressed with the dictionary), so records can be read one by one. The dictionary is built
once from archived records: about SAMPLE_RECORDS (never over twice as many) of at most SAMPLE_BYTES each, by a hash
of the row; this bounds what the driver gathers. Every record is written whole, whatever its size.

Of records with equal payloads the one with the smallest page_id is a response and the others are revisits that
refer to it. Payloads are compared by SHA-1, combined before the shuffle; the html itself is moved once, by row.
Files are written under a name of the attempt and renamed, in the shared folder.

Defined results: null html is an empty payload; null page_ids come last among equals and stay null; rows that
repeat are separate records; an empty table gives no file and no row; with too few records for a dictionary the
files have none. Columns other than page_id, url and html are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .common import attach, numbered, table

#: The skippable frame's magic number, and the profile that revisits name.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes from which equal payloads are written once.
LEAST_BYTES = 0
DICTIONARY_BYTES = 64 << 10
SAMPLE_RECORDS = 1000
#: What the dictionary's trainer needs, in records and bytes.
LEAST_RECORDS = 16
LEAST_TRAINED = 16 << 10
SAMPLE_BYTES = 64 << 10
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"  # the pages have no time of their own
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of UUIDs


def roles(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """The pages with row id, digest and size, and per revisit what it refers to."""
    html = F.coalesce(F.col("row.html").cast("string"), F.lit(""))
    rows = numbered(pages, "warc-pages").select(
        "rid", F.col("row.page_id").cast("long").alias("page_id"), F.col("row.url").cast("string").alias("url"),
        html.alias("html"), F.unhex(F.sha1(F.encode(html, "UTF-8"))).alias("digest"),
        F.octet_length(html).cast("long").alias("bytes"))
    light = materialise(rows.drop("html").filter(F.col("bytes") >= least_bytes).drop("bytes"), "warc-digests")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rid", "url")).alias("first")
    groups = light.groupBy("digest").agg(first, F.count("*").alias("n")).filter("n > 1")
    groups = materialise(groups.select("digest", "n", F.col("first.page_id").alias("to_id"),
                                       F.col("first.rid").alias("to_rid"), F.col("first.url").alias("to_url")), "warc-groups")
    revisits = attach(light.select("rid", "digest"), groups, "digest", "n").filter("rid <> to_rid")
    return rows, revisits.select("rid", "to_id", "to_rid", "to_url")


def _name(page_id: int | None, rid: dict) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'page:{page_id}:{rid['file']}:{rid['at']}')}>"


def _line(name: str, value: str | None) -> str:
    """A header; signs that would end it are percent-encoded."""
    if value is None:
        return ""
    safe = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)
    return f"{name}: {safe}\r\n"


def record(row: dict) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP header alone."""
    payload = row["html"].encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row["to_rid"] is not None
    block = http if revisit else http + payload
    head = "WARC/1.1\r\n" + _line("WARC-Type", "revisit" if revisit else "response")
    head += _line("WARC-Record-ID", _name(row["page_id"], row["rid"])) + _line("WARC-Date", DATE)
    head += _line("WARC-Target-URI", row["url"])
    head += _line("WARC-Payload-Digest", "sha1:" + base64.b32encode(row["digest"]).decode())
    if row["page_id"] is not None:
        head += _line("X-Page-ID", str(row["page_id"]))
    if revisit:
        head += _line("WARC-Profile", REVISIT_PROFILE) + _line("WARC-Refers-To", _name(row["to_id"], row["to_rid"]))
        head += _line("WARC-Refers-To-Target-URI", row["to_url"]) + _line("WARC-Refers-To-Date", DATE)
        if row["to_id"] is not None:
            head += _line("X-Refers-To-Page-ID", str(row["to_id"]))
    head += _line("Content-Type", "application/http; msgtype=response") + _line("Content-Length", str(len(block)))
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(rows: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """Trained on the bounded sample. Where the trainer can't work (too few records, or nothing that they share), the
    last ``size`` bytes of the sampled records themselves, which serve as a dictionary of raw content; where no payload
    is small enough for the sample, those of some records' headers. Empty for an empty table alone."""
    import zstandard

    share = int(min(1.0, SAMPLE_RECORDS / max(rows.count(), 1)) * (1 << 20)) + 1
    sample = rows.filter((F.col("bytes") <= SAMPLE_BYTES) & (F.pmod(F.xxhash64("page_id", "digest"), F.lit(1 << 20)) < share))
    sample = sample.limit(2 * SAMPLE_RECORDS).collect() or rows.withColumn("html", F.lit("")).limit(LEAST_RECORDS).collect()
    records = [record(r.asDict(recursive=True) | {"to_rid": None}) for r in sorted(sample, key=lambda r: (r.digest, r.rid))]
    total = sum(map(len, records))
    if len(records) >= LEAST_RECORDS and total >= LEAST_TRAINED:
        try:
            return zstandard.train_dictionary(min(size, total // 8), records).as_bytes()
        except zstandard.ZstdError:  # the trainer finds nothing that records share
            pass
    return b"".join(records)[-size:]


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes all pages; returns the files (path, records)."""
    spark = pages.sparkSession
    rows, revisits = roles(pages, least_bytes)
    trained = spark.sparkContext.broadcast(dictionary(rows))
    fs, at = pafs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        out, records = None, 0
        path = f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc.zst"
        fs, at = pafs.FileSystem.from_uri(path)
        own = f"{at}.{uuid.uuid4().hex}"
        known = trained.value
        packer = zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(known) if known else None)
        for batch in batches:
            for k in range(batch.num_rows):
                if out is None:
                    out = fs.open_output_stream(own)
                    if known:
                        out.write(DICTIONARY_MAGIC.to_bytes(4, "little") + len(known).to_bytes(4, "little") + known)
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                out.write(packer.compress(record(row)))
                records += 1
        if out is not None:
            out.close()
            fs.move(own, at)
            yield pa.RecordBatch.from_pylist([{"path": path, "records": records}])

    joined = rows.join(revisits, "rid", "left")
    return materialise(joined.mapInArrow(store, "path string, records long"), "warc-files")


def _records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file."""
    import zstandard

    fs, at = pafs.FileSystem.from_uri(path)
    source = fs.open_input_file(at)
    known = None
    if int.from_bytes(source.read(4), "little") == DICTIONARY_MAGIC:
        known = zstandard.ZstdCompressionDict(source.read(int.from_bytes(source.read(4), "little")))
    else:
        source.seek(0)
    text = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=known).stream_reader(source, read_across_frames=True), 1 << 20)
    while text.readline():
        headers = {}
        while line := text.readline().strip():
            name, _, value = line.decode().partition(": ")
            headers[name] = value
        block = text.read(int(headers["Content-Length"]))
        text.read(4)
        yield headers, block


def read(files: DataFrame) -> DataFrame:
    """Every record of the files: page_id, url, record_type, refers_to, payload_bytes, payload_digest, html."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("html", pa.string())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                for headers, block in _records(path):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = headers["WARC-Type"] == "revisit"
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    if not revisit and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{path}: damaged record {headers['WARC-Record-ID']}")
                    ids = [int(x) if (x := headers.get(name)) else None for name in ("X-Page-ID", "X-Refers-To-Page-ID")]
                    held.append({"page_id": ids[0], "url": headers.get("WARC-Target-URI"), "record_type": headers["WARC-Type"],
                                 "refers_to": ids[1], "payload_bytes": length, "payload_digest": digest,
                                 "html": None if revisit else payload.decode()})
                    size += len(payload)
                    if size > 8 << 20 or len(held) >= 1000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return files.repartition(max(1, files.count())).mapInArrow(
        load, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every page as read back from the archives."""
    files = write(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
