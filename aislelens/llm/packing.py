"""Packing (operator 9): concatenate and cut, by two-pass prefix sums over partition token totals.

Pass 1 encodes each document once, appends the end id and writes, per partition, the ids and their running
offset in the partition. The totals (one row per partition) give each partition's global offset. Pass 2 adds
the two and cuts windows of ``size`` ids, which follow from the global offset alone: no ids are shuffled. Each window
is written once, with its members (which part of which document lies where in it). Windows that lie in one
partition are complete there; the parts of a window that crosses partitions are boundary records, which are joined
by window. The pieces of documents are read from the written sequences.

Only the last window has padding. Defined results: null text is empty, and an empty text is its end id alone;
a text longer than a window goes on in the next ones; repeated rows are packed as often as they come; an empty
table gives no piece and no sequence. Extra columns are not carried. Reruns over the same files agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path
from .common import table
from .token_ids import vocabulary, worker_encoder

SEQUENCE = 2048
END_ID = 1
PAD_ID = 0
#: Documents encoded at once.
ROWS = 2500


def encoded(docs: DataFrame, vocab, end_id: int = END_ID) -> DataFrame:
    """Pass 1: (part, at, doc_id, doc_tokens, ids) written to the shared folder; ``at``: ids before in the part."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = worker_encoder(vocab.value), TaskContext.get().partitionId(), 0
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):  # the ids of few documents are held at once
                some = batch.slice(k, ROWS)
                ids = [x.tobytes() + end for x in encoder.encode(some.column("text"))]
                n = [len(x) // 4 for x in ids]
                starts = []
                for size in n:
                    starts.append(at)
                    at += size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(n), pa.int64()), pa.array(starts, pa.int64()), some.column("doc_id"),
                     pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["part", "at", "doc_id", "doc_tokens", "ids"])

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    path = scratch_path(spark, "packing-ids")
    (rows.mapInArrow(encode, "part long, at long, doc_id long, doc_tokens long, ids binary")
     .write.option("compression", "zstd").parquet(path))
    return spark.read.parquet(path)


def placed(ids: DataFrame) -> DataFrame:
    """Pass 2: ``first``, each document's place in the concatenation of all partitions."""
    totals = ids.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    # one row of 16 bytes per partition of the input: the broadcast is bounded by their number
    return ids.join(F.broadcast(bases), "part").withColumn("first", F.col("base") + F.col("at")).drop("base")


MEMBERS = "array<struct<doc_id: long, start: long, length: long, doc_tokens: long, offset: long>>"
#: Bytes of cut windows given on at once.
BATCH_BYTES = 8 << 20


class _Cuts:
    """Windows and parts of windows as a record batch: sequence_id, offset, ids (of whole windows), part (ids of the
    others, in a column of its own that is read without the whole ones), members."""

    NAMES = ("doc_id", "start", "length", "doc_tokens", "offset")

    def __init__(self, window_bytes: int):
        self.window_bytes = window_bytes
        self.windows: list[tuple[int, int, bytes]] = []
        self.ends = [0]
        self.members: list[tuple[int | None, int, int, int, int]] = []
        self.size = 0

    def add(self, window: int, offset: int, ids: bytes, members: list) -> None:
        self.windows.append((window, offset, ids))
        self.members += members
        self.ends.append(len(self.members))
        self.size += len(ids)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.members, strict=True)) or [()] * len(self.NAMES)
        members = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], self.NAMES)
        numbers, offsets, ids = zip(*self.windows, strict=True)
        whole = [x if len(x) == self.window_bytes else None for x in ids]
        part = [None if len(x) == self.window_bytes else x for x in ids]
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64()), pa.array(whole, pa.binary()), pa.array(part, pa.binary()),
             pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), members)],
            ["sequence_id", "offset", "ids", "part", "members"])


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Whole windows, and what is left where the places break off or the rows end."""
    out, held, members, window, begin, place = _Cuts(4 * size), bytearray(), [], 0, 0, -1
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("first", "doc_id", "doc_tokens"))
        for first, doc_id, n, ids in zip(*columns, batch.column("ids"), strict=True):
            if held and place != first:
                out.add(window, begin, bytes(held), members)
                held, members = bytearray(), []
            data, at = memoryview(ids.as_buffer()), 0
            while at < n:
                window, offset = divmod(first + at, size)
                if not held:
                    begin = offset
                take = min(n - at, size - offset)
                held += data[4 * at:4 * (at + take)]
                members.append((doc_id, at, take, n, offset))
                at += take
                if offset + take == size:
                    out.add(window, begin, bytes(held), members)
                    held, members = bytearray(), []
                    if out.size > BATCH_BYTES:
                        yield out.batch()
                        out = _Cuts(4 * size)
            place = first + n
    if held:
        out.add(window, begin, bytes(held), members)
    if out.windows:
        yield out.batch()


def sequences(placed_ids: DataFrame, size: int = SEQUENCE, pad_id: int = PAD_ID) -> DataFrame:
    """The packed sequences, written once: (sequence_id, n_tokens, ids, members), padded to ``size``."""
    path = scratch_path(placed_ids.sparkSession, "packing-sequences")
    (placed_ids.select("first", "doc_id", "doc_tokens", "ids")
     .mapInArrow(lambda batches: _cut(batches, size), f"sequence_id long, offset long, ids binary, part binary, members {MEMBERS}")
     .write.parquet(path))
    cuts = placed_ids.sparkSession.read.parquet(path)
    n_tokens = F.lit(size).cast("long").alias("n_tokens")
    whole = cuts.filter("part IS NULL").select("sequence_id", n_tokens, "ids", "members")
    # boundary records: at most two per partition and file split; a window has at most `size` of them
    parts = cuts.filter("part IS NOT NULL").groupBy("sequence_id").agg(
        F.sum(F.floor(F.length("part") / 4)).alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("offset", F.col("part").alias("ids"), "members"))).alias("parts"))
    pad = F.lit(pad_id.to_bytes(4, "little"))
    fill = F.unhex(F.repeat(F.hex(pad), (F.lit(size) - F.col("n_tokens")).cast("int")))
    joined = F.aggregate("parts", F.lit(b""), lambda x, p: F.concat(x, p["ids"]))
    return whole.unionByName(parts.select("sequence_id", "n_tokens", F.concat(joined, fill).alias("ids"),
                                          F.flatten(F.transform("parts", lambda p: p["members"])).alias("members")))


def pieces(packed: DataFrame) -> DataFrame:
    """One row per piece of a document in a sequence, with its ids, from the sequences."""
    m = F.col("m")
    ids = F.substring(F.col("ids"), (m["offset"] * 4 + 1).cast("int"), (m["length"] * 4).cast("int"))
    return packed.select("sequence_id", "ids", F.explode("members").alias("m")).select(
        "m.doc_id", "m.start", "m.length", "m.doc_tokens", "sequence_id", "m.offset", ids.alias("ids"))


def pack(docs: DataFrame, size: int = SEQUENCE, tokenizer_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The pieces and the padded sequences of all documents."""
    packed = sequences(placed(encoded(docs, vocabulary(docs.sparkSession, tokenizer_path))), size)
    return pieces(packed), packed


def digest_rows(docs: DataFrame) -> DataFrame:
    cut, _ = pack(docs)
    return cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every piece of every document, in sequences of 2048."""
    return digest_rows(table(spark, sf_dir, "documents"))
