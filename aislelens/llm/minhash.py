"""Document fingerprints (operator 5): MinHash over word shingles in vectorised numpy.

A text's shingles are its runs of five lower-cased words (fewer words: the whole sequence). PERMUTATIONS universal
hashes x -> a*x + b (mod 2^64) give a minimum each; the fingerprint holds 16 mixed bits of each minimum, and the
likeness of two fingerprints, the share of equal parts, estimates the Jaccard similarity of the shingle sets.

``near_duplicates`` joins bands of the fingerprints in Spark and verifies the exact Jaccard similarity. Texts with
equal shingle sets are one class first. A band's bucket is cut into blocks, each pair of blocks is a task, and a
task reports a spanning forest of its verified links, so no bucket is gathered whole and no pairs of copies are
listed.

Defined results: null text is empty; texts without words have one fingerprint of their own (likeness 1 to each
other); null doc_id comes last in every order, ties in order of the text; repeated rows have equal fingerprints; an
empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .common import attach, table
from .components import components
from .token_ids import text_parts

SHINGLE = 5
SIMILARITY = 0.8
PERMUTATIONS = 128
#: Rows of a band: 25 bands of 5 find a pair of similarity 0.8 but for 1 in 20,000.
BAND_ROWS = 5
SEED = 5
#: Shingles hashed at once (they stay in the processor's cache), and characters of a group of texts.
CHUNK = 1 << 15
GROUP = 2 << 20
SLICE = 8 << 20
#: Classes of a block of a band's bucket.
BLOCK = 256

_RNG = np.random.Generator(np.random.Philox(SEED))
FACTORS = _RNG.integers(0, 1 << 64, PERMUTATIONS, np.uint64, endpoint=False) | np.uint64(1)
OFFSETS = _RNG.integers(0, 1 << 64, PERMUTATIONS, np.uint64, endpoint=False)
STEPS = _RNG.integers(0, 1 << 64, SHINGLE, np.uint64, endpoint=False) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, and the words per text."""
    from xxhash import xxh64_intdigest

    words = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    flat = words.flatten()
    full = pc.not_equal(flat, "")
    per_text = pc.list_value_length(words).to_numpy()
    if not pc.all(full, min_count=0).as_py():  # white space at an end leaves an empty word
        ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        cuts = np.concatenate([[0], np.cumsum(per_text)])
        per_text, flat = np.diff(ends[cuts]), flat.filter(full)
    coded = flat.dictionary_encode()
    hashes = np.array([xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    which = coded.indices.to_numpy()
    return (hashes[which] if len(which) else hashes), per_text


def _shingles(words: np.ndarray, per_text: np.ndarray, least: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts one after another, and how many each has."""
    starts = np.cumsum(per_text) - per_text
    n = np.where(per_text >= least, per_text - least + 1, np.minimum(per_text, 1))
    first = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    sizes = np.repeat(np.minimum(per_text, least), n)
    x = np.zeros(len(first), np.uint64)
    for k in range(least):
        there = sizes > k
        if there.all():
            x += words[first + k] * STEPS[k]
        else:
            x[there] += words[first[there] + k] * STEPS[k]
    x ^= x >> np.uint64(31)
    return x * MIX, n


def _minima(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """PERMUTATIONS minima for each text with n of the hashes; all NONE where it has none."""
    out = np.full((len(n), PERMUTATIONS), NONE, np.uint64)
    there = np.flatnonzero(n)
    if not len(there):
        return out
    ends = np.cumsum(n[there])
    starts = np.unique(np.concatenate([np.arange(0, len(x), CHUNK), ends - n[there]]))  # of runs in chunk and text
    mins = np.empty((len(starts), PERMUTATIONS), np.uint64)
    buf = np.empty(CHUNK, np.uint64)
    chunk_of = np.searchsorted(starts, np.arange(0, len(x) + CHUNK, CHUNK))
    for c, (i, j) in enumerate(zip(chunk_of[:-1], chunk_of[1:], strict=True)):
        part = x[c * CHUNK:(c + 1) * CHUNK]
        local, hashed = starts[i:j] - c * CHUNK, buf[:len(part)]
        for k in range(PERMUTATIONS):
            np.multiply(part, FACTORS[k], out=hashed)
            hashed += OFFSETS[k]
            mins[i:j, k] = np.minimum.reduceat(hashed, local)
    out[there] = np.minimum.reduceat(mins, np.searchsorted(starts, ends - n[there]), axis=0)
    return out


def _long_hashes(text: str) -> Iterator[np.ndarray]:
    """The shingle hashes of a long text, slice by slice."""
    carry, seen = np.zeros(0, np.uint64), 0
    for part in text_parts(text.encode()):
        words, n = _word_hashes(pa.array([part.decode()]))
        seen += int(n[0])
        words = np.concatenate([carry, words])
        if len(words) >= SHINGLE:
            yield _shingles(words, np.array([len(words)]))[0]
        carry = words[1 - SHINGLE:]
    if 0 < seen < SHINGLE:
        yield _shingles(carry, np.array([len(carry)]))[0]


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of PERMUTATIONS 16-bit parts for each text."""
    long = [k for k, t in enumerate(texts) if len(t) > SLICE]
    words, per_text = _word_hashes(pa.array(["" if len(t) > SLICE else t for t in texts], pa.string()))
    mins = _minima(*_shingles(words, per_text))
    for k in long:
        for x in _long_hashes(texts[k]):
            mins[k] = np.minimum(mins[k], _minima(x, np.array([len(x)]))[0])
    mixed = (mins ^ (mins >> np.uint64(29))) * MIX
    return (mixed >> np.uint64(48)).astype(np.uint16)


def _hex(parts: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in parts]


def edited(text: str, following: str) -> str:
    """The text with its second half (the smaller one) replaced by as much of the following text's beginning."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _order(docs: DataFrame, parts: int) -> DataFrame:
    """The rows in descending order of doc_id (null last, ties by text), dealt to ``parts`` ranges; each range ends
    with the first row of the next one (``more``), the last range with the first row of all.

    Ranges are cut at quantiles of doc_id; one key per range goes through the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    shares = [k / parts for k in range(1, parts)]
    cuts = rows.agg(F.percentile_approx("key", shares, max(10_000, 20 * parts))).first()[0] if shares else []
    cuts = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, key.to_numpy(), "left"), dtype="int32")

    firsts = sorted((r.part, r.key) for r in rows.select(part_of("key").alias("part"), "key")
                    .groupBy("part").agg(F.max("key").alias("key")).collect())
    keys = np.array(sorted(k for _, k in firsts), np.int64)
    before = {key: firsts[k - 1][0] for k, (_, key) in enumerate(firsts)}
    targets = np.array([before[k] for k in keys.tolist()], np.int32)

    @F.pandas_udf("int")
    def sent_to(key: pd.Series) -> pd.Series:
        at = np.minimum(np.searchsorted(keys, key.to_numpy()), len(keys) - 1)
        return pd.Series(np.where(keys[at] == key.to_numpy(), targets[at], -1), dtype="int32")

    dealt = F.array(F.struct(part_of("key").alias("part"), F.lit(False).alias("more")),
                    F.struct(sent_to("key").alias("part"), F.lit(True).alias("more")))
    dealt = rows.select("doc_id", "key", "text", F.explode(dealt).alias("to")).filter("to.part >= 0")
    dealt = dealt.select("doc_id", "key", "text", "to.part", "to.more")
    return (dealt.repartitionById(len(cuts) + 1, "part")
            .sortWithinPartitions("part", "more", F.col("key").desc(), "text"))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                    ("near_next", pa.float64())])


def _compared(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
    """Results for all texts but the last, each with the one after it."""
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    own, other = fingerprints(texts), fingerprints(changed)
    return pa.RecordBatch.from_arrays([
        pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(_hex(own[:-1])),
        pa.array(_hex(other)), pa.array((own[:-1] == other).mean(1)), pa.array((own[:-1] == own[1:]).mean(1))], schema=RESULT)


def edits(docs: DataFrame, part_bytes: int = 16 << 20) -> DataFrame:
    """Per document: its fingerprint, its edited text's, and their likeness and that to the next document."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = _order(docs, max(1, -(-size // part_bytes)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[str] = []
        part, closed, held = None, False, 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "more", "doc_id"))
            for p, more, doc_id, text in zip(*columns, batch.column("text"), strict=True):
                if p != part:
                    ids, texts, part, closed, held = [], [], p, False, 0
                if closed:  # another row with the first row's doc_id
                    continue
                closed = more
                ids.append(doc_id)
                texts.append(text.as_py())
                held += len(texts[-1])
                if len(texts) > 1 and (closed or held > GROUP):
                    yield _compared(ids, texts)
                    ids, texts, held = ids[-1:], texts[-1:], len(texts[-1])

    return ordered.select("doc_id", "text", "part", "more").mapInArrow(
        compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                 "near_edited double, near_next double")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: its bands' hashes, its fingerprint, its sorted shingle set, and the set's digest."""
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            some = batch.slice(k, 200)
            texts = [t or "" for t in some.column("text").to_pylist()]
            prints = fingerprints(texts)
            sets = []
            for t in texts:
                sets.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *_long_hashes(t)])))
            bands = [[int.from_bytes(hashlib.blake2b(bytes([b]) + row[b * BAND_ROWS:(b + 1) * BAND_ROWS].tobytes(), digest_size=8)
                                     .digest(), "little", signed=True) for b in range(PERMUTATIONS // BAND_ROWS)] for row in prints]
            yield pa.RecordBatch.from_arrays([
                some.column("rid"), some.column("doc_id"), pa.array([hashlib.sha1(s.tobytes()).digest() for s in sets], pa.binary()),
                pa.array(bands, pa.list_(pa.int64())), pa.array([r.tobytes() for r in prints], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary())], ["rid", "doc_id", "same", "bands", "print", "shingles"])


def verified(prints: np.ndarray, sets: list[np.ndarray], ids: np.ndarray, left: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``left`` rows and all rows."""
    up = list(range(len(ids)))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    links = []
    size = np.array([len(s) for s in sets])
    for i in np.flatnonzero(left):
        # no two sets are more alike than the smaller is large; the likeliest pairs first, as links spare tests
        able = np.flatnonzero(np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]))
        for j in able[np.argsort(-(prints[able] == prints[i]).mean(1), kind="stable")]:
            if i == j or root(i) == root(j):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
                links.append((int(ids[i]), int(ids[j])))
    return links


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id): class_id is the smallest doc_id of the texts that verified links lead to."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(
        _sets, "rid long, doc_id long, same binary, bands array<long>, print binary, shingles binary")
    rows = materialise(rows, "minhash-sets")
    classes = rows.groupBy("same").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("first"), F.count("*").alias("n"))
    classes = materialise(classes.withColumnRenamed("rid", "cid"), "minhash-classes")
    members = classes.select("cid").join(rows, F.col("cid") == F.col("rid")).select("cid", "bands", "print", "shingles")
    members = materialise(members.filter(F.length("shingles") > 0), "minhash-members")
    bands = members.select("cid", F.explode("bands").alias("bucket"))
    shared = materialise(bands.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"), "minhash-buckets")
    held = attach(bands, shared, "bucket", "m")
    blocks = F.ceil(F.col("m") / BLOCK)
    held = held.select("bucket", "cid", F.pmod(F.xxhash64("cid"), blocks).alias("own"), blocks.alias("blocks"))
    held = held.select("bucket", "cid", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    held = held.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "cid")
    held = held.join(members.select("cid", "print", "shingles"), "cid")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        prints = np.stack([np.frombuffer(x, np.uint16) for x in pdf["print"]])
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        found = verified(prints, sets, pdf["cid"].to_numpy(), (pdf["own"] == pdf["a"]).to_numpy(), similarity)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    links = held.groupBy("bucket", "a", "b").applyInPandas(verify, "a long, b long")
    roots = components(links).select(F.col("node").alias("cid"), "root")
    joined = materialise(classes.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "minhash-roots")
    least = joined.groupBy("root").agg(F.min("first").alias("class_id"))
    known = materialise(joined.join(least, "root").select("same", "n", "class_id"), "minhash-known")
    return attach(rows.select("doc_id", "same"), known, "same", "n").select("doc_id", "class_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document's fingerprint and that of its edited text."""
    return edits(table(spark, sf_dir, "documents"))
