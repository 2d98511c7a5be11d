"""Sharding (operator 13, native): a histogram sort into shards of near equal bytes.

Rows are ordered by a key of three parts: the hash of the text (so that equal texts stand together), the hash of
the doc_id, the row's place. The bytes below candidate boundaries are counted exactly over all partitions: a round
cuts the key range around each wanted splitter into PROBES equal parts and sums the sizes in each (combined before
the shuffle, so a round brings at most PROBES numbers for each splitter to the driver). The part that holds the
wanted number of bytes is cut again, until a boundary lies within ``tolerance`` of it. So equal texts share a
shard, unless a splitter falls into a group that is larger than the tolerance allows; such a group is cut by the
later key parts. Then the rows are exchanged once, by shard and key, into many partitions of each shard.

Defined results: null text has no bytes and counts as equal to empty text; null doc_ids hash like any value; rows
that repeat are told apart by their place; a row larger than the tolerance is never cut, the nearer end is taken;
fewer rows than shards leave shards empty; an empty table gives an empty result. Extra columns of any name pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .common import numbered, table

SHARDS = 8
#: The bytes below a splitter are off by this share of a shard at most, where rows are small enough.
TOLERANCE = 0.001
#: A round cuts a range into 2 ** PROBE_BITS parts.
PROBE_BITS = 12
KEY_BITS = 64
#: Bytes of a partition of the exchange, and partitions of a shard at least.
PART_BYTES = 128 << 20
LEAST_PARTS = 4

#: Key parts, first to last; ``place`` names the row in the input.
KEYS = ("text_key", "id_key", "file", "place")


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _keyed(rows: DataFrame) -> DataFrame:
    """Numbered rows with their size and the parts of their key (signed longs)."""
    text, doc_id = F.col("row").getField("text"), F.col("row").getField("doc_id")
    return rows.select("row", _size(text).alias("size"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"),
                       F.xxhash64(doc_id).alias("id_key"), F.col("rid.file").alias("file"), F.col("rid.at").alias("place"))


@dataclass
class _Search:
    """A wanted splitter: the bytes it shall have below it, and the key range in which it lies.

    The range is all keys that equal ``fixed`` in the first parts and, in the next one, lie in the ``1 << bits``
    values from ``low`` on (unsigned). ``below`` are the bytes below the range, ``held`` those in it.
    """

    wanted: float
    below: int
    held: int
    fixed: tuple[int, ...] = ()
    low: int = 0
    bits: int = KEY_BITS
    found: tuple[int, ...] | None = None

    def settle(self, slack: float) -> None:
        """Takes an end of the range if it is near enough, or else if no key lies inside."""
        first, last = self.wanted - self.below, self.below + self.held - self.wanted
        if min(first, last) <= slack or not self.bits and len(self.fixed) == len(KEYS) - 1:
            self.found = self.fixed + (self.low,) if first <= last else _after(self.fixed, self.low, self.bits)
        elif not self.bits:
            self.fixed, self.low, self.bits = (*self.fixed, self.low), 0, KEY_BITS


def _after(fixed: tuple[int, ...], low: int, bits: int) -> tuple[int, ...]:
    """The least key prefix above all keys of a range; empty (above every key) at the very end."""
    low += 1 << bits
    while low >> KEY_BITS and fixed:
        *rest, last = fixed
        fixed, low = tuple(rest), last + 1
    return () if low >> KEY_BITS else (*fixed, low)


def _signed(x: int) -> int:
    """The signed long whose order among signed longs is that of ``x`` among unsigned ones."""
    return x - (1 << (KEY_BITS - 1))


def _unsigned(part: str) -> Column:
    """The bits of a key part such that their unsigned order is the part's signed order."""
    return F.col(part).bitwiseXOR(F.lit(-(1 << 63)))


def _histogram(keys: DataFrame, searches: list[_Search]) -> dict[tuple, dict[int, int]]:
    """For each range: the bytes in each of its equal parts that has any."""
    ranges = list({(s.fixed, s.low, s.bits) for s in searches})
    which, probe = F.lit(None).cast("int"), F.lit(None).cast("long")
    for n, (fixed, low, bits) in enumerate(ranges):
        part, inside = KEYS[len(fixed)], F.lit(True)
        for name, value in zip(KEYS, fixed, strict=False):
            inside &= F.col(name) == _signed(value)
        inside &= F.col(part).between(_signed(low), _signed(low + (1 << bits) - 1))
        step = max(0, bits - PROBE_BITS)
        value = F.shiftrightunsigned(_unsigned(part), step).bitwiseAND((1 << min(bits, PROBE_BITS)) - 1)
        which, probe = F.when(inside, F.lit(n)).otherwise(which), F.when(inside, value).otherwise(probe)
    counted = (keys.select(which.alias("which"), probe.alias("probe"), "size").filter("which IS NOT NULL")
               .groupBy("which", "probe").agg(F.sum("size").alias("bytes")))
    out: dict[tuple, dict[int, int]] = {r: {} for r in ranges}
    for r in counted.collect():
        out[ranges[r["which"]]][r["probe"]] = r["bytes"]
    return out


def splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """The least keys (prefixes of the unsigned parts) of the shards 1 and up; ``()`` lies above every key."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    searches = [_Search(total * k / shards, 0, total) for k in range(1, shards)]
    slack = tolerance * total / shards
    while todo := [s for s in searches if s.found is None]:
        counts = _histogram(keys, todo)
        for s in todo:
            step = max(0, s.bits - PROBE_BITS)
            below = s.below
            held, low = 0, s.low
            for probe, size in sorted(counts[s.fixed, s.low, s.bits].items()):
                held, low = size, s.low + (probe << step)
                if below + size >= s.wanted:
                    break
                below += size
            s.below, s.held, s.low, s.bits = below, held, low, step
            s.settle(slack)
    return [s.found for s in searches]


def _reached(splitter: tuple[int, ...]) -> Column:
    """Whether a row's key is not below the splitter."""
    if not splitter:
        return F.lit(False)
    part, value = F.col(KEYS[len(splitter) - 1]), _signed(splitter[-1])
    out = part >= value
    for name, value in reversed(list(zip(KEYS, splitter[:-1], strict=False))):
        out = (F.col(name) > _signed(value)) | (F.col(name) == _signed(value)) & out
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(row, size, shard, slot): the rows of ``docs``, packed; slots run through each shard in key order.

    The result is materialised: its files hold one stretch of one shard or of neighbouring ones.
    """
    rows = _keyed(numbered(docs, "shard-rows"))
    keys = materialise(rows.drop("row"), "shard-keys")
    found = splitters(keys, shards, tolerance)
    shard = sum((F.when(_reached(s), 1).otherwise(0) for s in found), F.lit(0)).cast("int")
    parts = max(shards * LEAST_PARTS, -(-(keys.agg(F.sum("size")).first()[0] or 0) // PART_BYTES))
    dealt = (rows.withColumn("shard", shard).repartitionByRange(parts, "shard", *KEYS)
             .sortWithinPartitions("shard", *KEYS).drop(*KEYS))
    # A row's number is its partition in the high bits and its place there, in order, in the lower 33.
    dealt = materialise(dealt.withColumn("number", F.monotonically_increasing_id()), "shards")
    part = F.shiftright("number", 33).cast("int")
    counts = dealt.groupBy(part.alias("part"), "shard").agg(F.count("*").alias("n"), F.min("number").alias("least"))
    starts, before = [], {}
    for r in sorted(counts.collect(), key=lambda r: (r["part"], r["shard"])):  # one row a partition, and a few more
        starts.append((r["part"], r["shard"], before.get(r["shard"], 0) - r["least"]))
        before[r["shard"]] = before.get(r["shard"], 0) + r["n"]
    shift = docs.sparkSession.createDataFrame(starts, "part int, shard int, shift long")
    return (dealt.withColumn("part", part).join(F.broadcast(shift), ["part", "shard"])
            .select("row", "size", "shard", (F.col("number") + F.col("shift")).alias("slot")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document's shard and slot, from the sharded rows."""
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "size", F.crc32(F.coalesce("row.text", F.lit(""))).alias("text_crc32"),
                      F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
