"""SimHash near-dedup (operator 1): tiled exact comparison of all fingerprints.

Distinct fingerprints are dealt by hash to G groups of at most GROUP_ROWS; each pair of groups is one task, which
holds 8 bytes per fingerprint. In it, each group is cut into tiles by the population counts of the fingerprint's
four 16-bit quarters (split at medians, so equal counts stay together). The distance of two fingerprints is at
least the sum of the differences of these counts, so a pair of tiles whose ranges of counts lie further apart than
the radius is skipped; every other pair is compared by exclusive-or and bit counts. No bucket, band or cap is
involved: every pair within the radius is found. The more fingerprints, the narrower the tiles and the larger the
share of skipped pairs. A task reports a spanning forest of its links, not all pairs of a group.

Defined results: null or wordless text has fingerprint zero, which links like any other; null doc_ids stand last
and a component of them alone has component_id null; rows that repeat are in one component; an empty table gives
an empty result. Extra columns of any name pass through ``near_dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .common import attach, numbered, table, unpacked
from .components import components
from .token_ids import text_parts

#: Fixed values of the contract.
SHINGLE = 4
RADIUS = 4
HASH_SEED = 42

#: Fingerprints of a group, and groups at least (so that there are some dozens of tasks).
GROUP_ROWS = 1_000_000
LEAST_GROUPS = 8
TILE = 512


def _hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of the text's lower-cased words."""
    from xxhash import xxh64_intdigest

    out, carry = [], []
    n_words = 0
    for part in text_parts((text or "").encode().lower()):  # bytes.lower() changes A-Z alone
        found = part.split()
        n_words += len(found)
        words = carry + found
        carry = words[1 - size:] if size > 1 else []
        if len(words) < size:
            carry = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])[:len(words) - size + 1].tolist()
        ends = (ends[size - 1:] - 1).tolist()
        out.append(np.array([xxh64_intdigest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends, strict=True)], np.uint64))
    if 0 < n_words < size:
        out.append(np.array([xxh64_intdigest(b" ".join(carry), HASH_SEED)], np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


LOW_BITS = np.uint64(0x0101010101010101)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each document: the bits set in over half its hashes.

    Eight bits are counted at a time, in the bytes of 64-bit sums over runs of at most 255 hashes.
    """
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(sizes), np.uint64)
    there = np.flatnonzero(sizes)
    if not len(there):
        return out
    h, n = np.concatenate([hashes[k] for k in there]), sizes[there]
    runs = -(-n // 255)
    first_run = np.cumsum(runs) - runs
    doc_start = np.repeat(np.cumsum(n) - n, runs)
    run_start = doc_start + 255 * (np.arange(runs.sum()) - np.repeat(first_run, runs))
    prints = np.zeros(len(there), np.uint64)
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & LOW_BITS, run_start)
        counts = sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.add.reduceat(counts, first_run, axis=0)
        for byte in range(8):
            prints |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + k)
    out[there] = prints
    return out


def fingerprints(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(rid, doc_id, fp) of rows (rid, doc_id, text); fp is the unsigned fingerprint as a signed long."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, fps, held, n = batch.column("text"), [], [], 0
            for t in texts:
                held.append(_hashes(t.as_py(), size))
                n += len(held[-1])
                if n > 1 << 19:
                    fps.append(majority(held))
                    held, n = [], 0
            fps.append(majority(held))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(
                np.concatenate(fps).view(np.int64))], ["rid", "doc_id", "fp"])

    kind = rows.schema["rid"].dataType.simpleString()
    return (rows.select("rid", F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(prints, f"rid {kind}, doc_id long, fp long"))


def _tiles(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of the fingerprints, the tiles' starts in it, and their least and greatest counts per quarter."""
    counts = np.bitwise_count(fps.astype("<u8").view("<u2").reshape(-1, 4)).astype(np.int8)
    todo, done = [np.arange(len(fps))], []
    while todo:
        part = todo.pop()
        own = counts[part]
        if len(part) > TILE:
            width = own.max(0) - own.min(0)
            q = int(np.argmax(own.std(0) + (width > 0)))
            if width[q]:
                cut = int(np.median(own[:, q]))
                low = own[:, q] <= cut if own[:, q].max() > cut else own[:, q] < cut
                todo += [part[low], part[~low]]
                continue
            done += [part[k:k + TILE] for k in range(0, len(part), TILE)]
        elif len(part):
            done.append(part)
    starts = np.cumsum([0, *[len(x) for x in done]])
    least = np.array([counts[x].min(0) for x in done], np.int16).reshape(-1, 4)
    most = np.array([counts[x].max(0) for x in done], np.int16).reshape(-1, 4)
    return np.concatenate(done) if done else np.zeros(0, np.int64), starts, least, most


class _Forest:
    """Union-find over the fingerprints of a task."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        at = self.up[nodes]
        while True:
            above = self.up[at]
            if np.array_equal(above, at):
                self.up[nodes] = at
                return at
            at = above

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the trees of each pair: the larger root under the smallest one offered, until all pairs agree."""
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def linked(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within the radius, of one group or between two: two arrays of fingerprints."""
    order_a, starts_a, least_a, most_a = _tiles(left)
    a = left[order_a]
    if right is None:
        b, starts_b, least_b, most_b, shift = a, starts_a, least_a, most_a, 0
    else:
        order_b, starts_b, least_b, most_b = _tiles(right)
        b, shift = right[order_b], len(a)
    every = a if right is None else np.concatenate([a, b])
    forest = _Forest(len(every))
    for i in range(len(starts_a) - 1):
        gaps = np.maximum(np.maximum(least_a[i] - most_b, least_b - most_a[i]), 0).sum(1)
        near = np.flatnonzero(gaps <= radius)
        if right is None:
            near = near[near >= i]
        own = a[starts_a[i]:starts_a[i + 1], None]
        for j in near:
            close = np.bitwise_count(own ^ b[None, starts_b[j]:starts_b[j + 1]]) <= radius
            if close.any():
                x, y = np.nonzero(close)
                x, y = x + starts_a[i], y + starts_b[j] + shift
                forest.link(x[x != y], y[x != y])
    roots = forest.roots(np.arange(len(every)))
    child = np.flatnonzero(roots != np.arange(len(every)))
    return every[child], every[roots[child]]


def links(prints: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect all of the ``n`` distinct fingerprints ``fp`` within the radius."""
    groups = max(LEAST_GROUPS, -(-n // GROUP_ROWS))
    own = F.pmod(F.xxhash64("fp"), F.lit(groups)).cast("int")

    def task(other):
        a, b = F.least(own, other), F.greatest(own, other)
        return (a * groups - F.floor(a * (a - 1) / 2) + b - a).cast("int")

    tasks = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), task)
    dealt = prints.select("fp", own.alias("own"), F.explode(tasks).alias("task"))
    dealt = dealt.repartitionById(groups * (groups + 1) // 2, "task")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            fp, g, t = (batch.column(c).to_numpy() for c in ("fp", "own", "task"))
            for k in np.unique(t):
                held.setdefault(int(k), []).append((fp[t == k], g[t == k]))
        for parts in held.values():
            fp = np.concatenate([x[0] for x in parts]).view(np.uint64)
            g = np.concatenate([x[1] for x in parts])
            low = g == g.min()
            a, b = linked(fp[low], None if low.all() else fp[~low], radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def grouped(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Materialised (rid, doc_id, fp) with ``root`` (the component's least fingerprint) and ``component_id``."""
    copies = prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    copies = materialise(copies, "simhash-prints")
    roots = components(links(copies, copies.count(), radius))
    members = materialise(copies.join(roots, F.col("fp") == F.col("node"), "left")
                          .select("fp", "n", "first", F.coalesce("root", "fp").alias("root")), "simhash-members")
    least = members.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
    several = least.filter("m > 1").select("root", "component_id")
    known = members.join(several, "root", "left").select(
        "fp", "n", "root", F.coalesce("component_id", "first").alias("component_id"))
    return attach(prints, materialise(known, "simhash-known"), "fp", "n").drop("n")


def near_dedup(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id."""
    rows = numbered(docs, "simhash-rows")
    read = rows.select("rid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    prints = materialise(fingerprints(read, size), "simhash-fps")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    stay = grouped(prints, radius).groupBy("root").agg(first.alias("first")).select("first.rid")
    return unpacked(rows.join(stay, "rid", "left_semi"), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document with its fingerprint and component."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id())
    out = grouped(materialise(fingerprints(rows), "simhash-fps"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
