"""Token-ID / binary output (operator 4): shards of raw ids with a minimal perfect hash index over the keys.

Documents are dealt to shards by ranges of doc_id, sorted, encoded and streamed into one file per shard:

    raw ids (unsigned little-endian, 2 or 4 bytes each, documents one after another)
    doc_ids and repeats of the documents in payload order (int64, uint32)
    the index: bits of each hash level, their ranks, and per slot fingerprint, offset, number of ids
    footer (JSON) with the place of each section, its length, magic

A key is (doc_id, repeat): rows that share a doc_id are repeats 0, 1, ... in text order. The hash has levels: at
each, the keys left over are hashed into as many bits as there are keys; a bit that exactly one key hits is that
key's, and the rank of the bit is its slot. So there are as many slots as keys, and a look-up reads a few bits, one
slot and the ids. The slot's fingerprint (32 bits of another hash) tells keys that the shard lacks.

Files are written under a name of the attempt and renamed, so a task that is run again replaces its file by an
equal one. Folder: the shared one. Defined results: null text is empty (the end id alone); null doc_id sorts last;
an empty table gives no file and no row. Extra columns are not carried.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise, scratch_path
from .common import table
from .token_ids import vocabulary, worker_encoder

MAGIC = b"ALTOKID1"
END_ID = 1
#: Bytes of text that a shard gets on average.
SHARD_BYTES = 32 << 20
LEVELS = 64
NO_ID = -(1 << 63)  # the key of a null doc_id

U64 = np.uint64


def _mixed(doc_ids: np.ndarray, repeats: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each key; a seed per level."""
    start = U64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    x = doc_ids.astype(np.int64).view(U64) + repeats.astype(U64) * U64(0xD1B54A32D192ED03) + start
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> U64(shift))) * U64(factor)
    return x ^ (x >> U64(31))


class PerfectHash:
    """key -> slot in 0..n-1, without the keys."""

    def __init__(self, widths: list[int], bits: np.ndarray):
        self.widths = widths
        self.starts = np.cumsum([0, *widths])
        self.bits = bits  # one byte per bit while in memory
        self.rank = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def build(cls, doc_ids: np.ndarray, repeats: np.ndarray) -> PerfectHash:
        left, widths, levels = np.arange(len(doc_ids)), [], []
        while len(left):
            if len(widths) == LEVELS:
                raise ValueError("keys are not distinct")
            width = len(left) + 1
            at = (_mixed(doc_ids[left], repeats[left], len(widths)) % U64(width)).astype(np.int64)
            hits = np.bincount(at, minlength=width)
            levels.append((hits == 1).astype(np.uint8))
            widths.append(width)
            left = left[hits[at] != 1]
        return cls(widths, np.concatenate(levels) if levels else np.zeros(0, np.uint8))

    def slots(self, doc_ids: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """The slot of each key (of a key that isn't there: any, or -1)."""
        out = np.full(len(doc_ids), -1, np.int64)
        left = np.arange(len(doc_ids))
        for level, width in enumerate(self.widths):
            at = (_mixed(doc_ids[left], repeats[left], level) % U64(width)).astype(np.int64) + self.starts[level]
            hit = self.bits[at] == 1
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return out


def _fingerprints(doc_ids: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    return (_mixed(doc_ids, repeats, LEVELS + 1) >> U64(32)).astype("<u4")


class ShardWriter:
    """Streams ids into a file; the index follows when the shard is complete."""

    def __init__(self, path: str, width: int):
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        self.width, self.own = width, f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.own)
        self.doc_ids: list[int] = []
        self.n_tokens: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)
        self.n_tokens.append(len(ids))
        self.out.write(ids.astype(f"<u{self.width}").tobytes())

    def close(self) -> tuple[int, int]:
        doc_ids, n = np.array(self.doc_ids, np.int64), np.array(self.n_tokens, np.int64)
        new = np.concatenate([[True], doc_ids[1:] != doc_ids[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(doc_ids)), 0))
        repeats = (np.arange(len(doc_ids)) - first).astype("<u4")
        hashed = PerfectHash.build(doc_ids, repeats)
        order = np.empty(len(doc_ids), np.int64)
        order[hashed.slots(doc_ids, repeats)] = np.arange(len(doc_ids))  # slot -> document
        sections = {
            "doc_ids": doc_ids.astype("<i8"), "repeats": repeats, "bits": np.packbits(hashed.bits),
            "fingerprints": _fingerprints(doc_ids, repeats)[order],
            "offsets": (np.cumsum(n) - n)[order].astype("<u8"), "lengths": n[order].astype("<u8"),
        }
        places, at = {}, int(n.sum()) * self.width
        for name, values in sections.items():
            data = values.tobytes()
            places[name] = [at, len(data), values.dtype.str]
            self.out.write(data)
            at += len(data)
        footer = json.dumps({"width": self.width, "docs": len(doc_ids), "ids": int(n.sum()), "levels": hashed.widths,
                             "sections": places}).encode()
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.own, self.path)
        return len(doc_ids), int(n.sum())


class Shard:
    """Reads one file: keyed access, and all its documents in order."""

    def __init__(self, path: str):
        fs, at = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(at)
        end = self.file.size()
        tail = self._read(end - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no token file")
        n = int.from_bytes(tail[:8], "little")
        self.meta = json.loads(self._read(end - 16 - n, n))
        self.hashed = PerfectHash(self.meta["levels"], np.unpackbits(self._section("bits"))[:sum(self.meta["levels"])])
        self.fingerprints, self.offsets, self.lengths = map(self._section, ("fingerprints", "offsets", "lengths"))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _section(self, name: str) -> np.ndarray:
        at, n, kind = self.meta["sections"][name]
        return np.frombuffer(self._read(at, n), kind)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return self._section("doc_ids"), self._section("repeats")

    def places(self, doc_ids: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length of each key's ids; length -1 where the shard lacks the key."""
        slots = self.hashed.slots(doc_ids, repeats)
        if not len(self.lengths):
            return np.zeros(len(slots), np.int64), np.full(len(slots), -1)
        there = (slots >= 0) & (self.fingerprints[slots] == _fingerprints(doc_ids, repeats))
        return self.offsets[slots].astype(np.int64), np.where(there, self.lengths[slots].astype(np.int64), -1)

    def ids(self, offset: int, length: int) -> np.ndarray:
        w = self.meta["width"]
        return np.frombuffer(self._read(offset * w, length * w), f"<u{w}")

    def get(self, doc_id: int | None, repeat: int = 0) -> np.ndarray | None:
        """The ids of one document, or None."""
        key = np.array([NO_ID if doc_id is None else doc_id], np.int64), np.array([repeat], np.uint32)
        (offset,), (length,) = self.places(*key)
        return None if length < 0 else self.ids(int(offset), int(length))


def write(docs: DataFrame, folder: str, tokenizer_path: str | None = None, shard_bytes: int = SHARD_BYTES,
          end_id: int = END_ID) -> DataFrame:
    """Writes the shards; returns their manifest (shard, path, n_docs, n_ids, first_doc, base), in doc_id order.

    ``base`` is the number of ids in all shards before: a prefix sum over one row per shard.
    """
    spark = docs.sparkSession
    vocab = vocabulary(spark, tokenizer_path)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fs, at = pafs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = worker_encoder(vocab.value), TaskContext.get().partitionId()
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        path, writer = f"{folder}/ids-{shard:06d}.bin", None
        end = np.array([end_id], "<u4")
        for batch in batches:
            ids = encoder.encode(batch.column("text"))
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                writer = writer or ShardWriter(path, width)
                writer.add(doc_id, np.concatenate([x, end]))
        if writer:
            n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "path": path, "n_docs": n_docs, "n_ids": n_ids}],
                pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    parts = max(1, -(-size // shard_bytes))
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_last())
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
    shards = materialise(dealt.mapInArrow(store, "shard long, path string, n_docs long, n_ids long"), "token-shards")
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return shards.withColumn("base", F.coalesce(before, F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the files, found by its key: (doc_id, repeat, start, n_tokens, ids)."""
    schema = pa.schema([("doc_id", pa.int64()), ("repeat", pa.int64()), ("start", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                doc_ids, repeats = shard.keys()
                offsets, lengths = shard.places(doc_ids, repeats)
                for k in range(0, len(doc_ids), 500):
                    some = range(k, min(k + 500, len(doc_ids)))
                    yield pa.RecordBatch.from_pylist([{
                        "doc_id": None if doc_ids[i] == NO_ID else int(doc_ids[i]), "repeat": int(repeats[i]),
                        "start": row["base"] + int(offsets[i]), "n_tokens": int(lengths[i]),
                        "ids": shard.ids(int(offsets[i]), int(lengths[i])).astype("<u4").tobytes()} for i in some], schema)

    count = max(1, manifest.count())
    return (manifest.repartition(count)
            .mapInArrow(load, "doc_id long, repeat long, start long, n_tokens long, ids binary"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document as read back from the files."""
    files = write(table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"))
    return read(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
