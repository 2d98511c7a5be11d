"""Mixing sources to target weights (operator 7): multivariate-hypergeometric splitting tree.

1. Targets. Sources in code point order (null last) weigh 5, 2, 1, 5, ... and share the words of all documents;
   no target is above 3 times its source's words, and the excess is shared again by weight.
2. Blocks. A source's documents stand in the order of a seeded hash; the source is read as often as its target
   asks (copy 0, 1, ...), and this stream is cut into blocks of ``block_words`` words: a document belongs to the block
   in which its copy begins. Documents are whole. The stream ends before the copy that would pass the target, and
   the gap is filled in FILL_ROUNDS rounds by one more copy of documents that stand less than MOST_COPIES times: in
   each the one that fits it best, in the last one the one that leaves the least, above or below; these join the
   last block.
3. Tree. The vector of all sources' block counts is split in two again and again, each time by a multivariate
   hypergeometric draw seeded by the node, until each output shard has its exact quota per source. The first
   levels run once; each task then carries on a subtree of its own.
4. Draw. A seeded affine permutation of a source's blocks deals them to the shards' quotas in turn, so the blocks
   of the shards are disjoint and together all. Rows are shuffled inside their shard by a seeded hash.

Prefix sums are taken in two passes over (source, slice of the hash order), so a source with a third of all rows is
spread over many tasks. Reruns agree: every draw depends on the data and the seed alone.

Defined results: null text has no words; a source without words has target 0; documents without words are never
drawn; repeated rows are separate documents; an empty table gives an empty result. Extra columns of any name pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise
from .common import WORD, numbered, table, unpacked

#: Fixed values of the contract.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3

SEED = 7
BLOCK_WORDS = 4096
SHARD_WORDS = 4 << 20
#: Rows of a slice of a source, on average at most.
SLICE_ROWS = 2_000
#: Documents that fill the gap before a source's target, at most.
FILL_ROUNDS = 4
#: Levels of the tree that are split before the subtrees are dealt out.
TOP_LEVELS = 6


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Adds source_no, weight and target to (source, source_size, ...): one row per source, so small windows.

    With the sources ordered by cap / weight, those whose share would pass the cap come first: a source keeps its
    cap if the words left, shared by the weights left, give it at least that.
    """
    every = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(every) - 1) % len(WEIGHTS) + 1)
    cap = F.col("source_size") * MOST_COPIES
    ranked = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", cap.cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    ranked = ranked.withColumn("rank", F.row_number().over(every))
    shared = (ranked.withColumn("left", total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
              .withColumn("level", F.col("left") / F.sum("weight").over(rest))
              .withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap")))
    # the level of the first source below its cap holds for all after it
    level = F.min(F.when(~F.col("capped"), F.struct("rank_by", "level"))).over(Window.partitionBy())
    shared = shared.withColumn("rank_by", F.row_number().over(by_ratio)).withColumn("final", level["level"])
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("final"))
    return shared.select(*sizes.columns, F.col("rank").alias("source_no"), "weight", target.alias("target"))


def positions(rows: DataFrame) -> DataFrame:
    """Adds ``pos``: the words of its source before each row in hash order; two passes, by slice and in the slice.

    A source of ``source_rows`` rows has a slice for every SLICE_ROWS of them, so slices are alike in every source.
    """
    rows = rows.withColumn("slice", F.pmod(F.shiftrightunsigned("h", 1), F.ceil(F.col("source_rows") / SLICE_ROWS)))
    sums = rows.groupBy("source_no", "slice").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_no").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source_no", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_no", "slice").orderBy("h", "rid").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return (local.join(bases, ["source_no", "slice"])
            .withColumn("pos", F.col("base") + F.col("local")).drop("slice", "base", "local"))


def _split(counts: np.ndarray, shards: int, node: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The block counts of the left half of a node's shards, of the right half, and the left shards."""
    left_shards = shards // 2
    total = int(counts.sum())
    draw = total * left_shards // shards
    rng = np.random.Generator(np.random.Philox(key=[seed, node]))
    left = np.zeros_like(counts)
    rest = total
    for k in np.flatnonzero(counts):  # marginal by marginal: exact for any size
        n = int(counts[k])
        left[k] = _hypergeometric(rng, n, rest - n, draw)
        rest -= n
        draw -= int(left[k])
    return left, counts - left, left_shards


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draw: int) -> int:
    if good + bad < 10 ** 9:
        return int(rng.hypergeometric(good, bad, draw))
    # numpy's limit: at such sizes the normal approximation, kept inside the support
    p = good / (good + bad)
    sd = (draw * p * (1 - p) * (good + bad - draw) / max(good + bad - 1, 1)) ** 0.5
    return int(min(max(round(rng.normal(draw * p, sd)), draw - bad, 0), good, draw))


def quotas(spark: SparkSession, blocks: list[int], shards: int, seed: int) -> DataFrame:
    """(shard, source_no, first, count): each shard's blocks of a source, as a range of the dealt order."""
    Node = tuple[int, int, int, np.ndarray, np.ndarray]  # node, first shard, shards, counts, firsts

    def halves(x: Node) -> list[Node]:
        node, shard, n, counts, firsts = x
        left, right, k = _split(counts, n, node, seed)
        return [(2 * node, shard, k, left, firsts), (2 * node + 1, shard + k, n - k, right, firsts + left)]

    top: list[Node] = [(1, 0, shards, np.array(blocks, np.int64), np.zeros(len(blocks), np.int64))]
    for _ in range(TOP_LEVELS):
        top = [y for x in top for y in (halves(x) if x[2] > 1 else [x])]
    rows = [(x[0], x[1], x[2], x[3].tolist(), x[4].tolist()) for x in top]
    frame = spark.createDataFrame(rows, "node long, shard long, shards long, counts array<long>, firsts array<long>")

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                todo: list[Node] = [(r.node, r.shard, r.shards, np.array(r.counts, np.int64), np.array(r.firsts, np.int64))]
                while todo:  # depth first: as many nodes at once as the subtree is deep
                    x = todo.pop()
                    if x[2] > 1:
                        todo += halves(x)
                        continue
                    k = np.flatnonzero(x[3])
                    yield pd.DataFrame({"shard": x[1], "source_no": k + 1, "first": x[4][k], "count": x[3][k]})

    return frame.repartition(len(rows)).mapInPandas(leaves, "shard long, source_no long, first long, count long")


def _coprime(n: int, seed: int) -> int:
    a = (seed * 2654435761 + n // 2) % n if n > 1 else 1
    while np.gcd(a := max(a, 1), n) != 1:
        a += 1
    return a


def draws(rows: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS,
          shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """Of numbered rows (rid, source, size, h): per copy that the mix takes (rid, copy, shard, size, h), and the targets."""
    spark = rows.sparkSession
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    goals = materialise(targets(sizes).withColumn(
        "quota", F.round("target").cast("long")), "mix-targets")
    # one row per source: the vector that the tree splits. Joins to it are left to Spark, which knows its size
    vector = goals.select("source_no", "quota").orderBy("source_no").collect()
    blocks = [-(-r.quota // block_words) for r in vector]
    steps = spark.createDataFrame([(r.source_no, n, _coprime(n, seed)) for r, n in zip(vector, blocks, strict=True)],
                                  "source_no int, blocks long, step long")
    shards = max(1, round(sum(r.quota for r in vector) / shard_words))
    placed = rows.select("rid", F.col("source").alias("s"), "size", "h").join(
        goals, F.col("s").eqNullSafe(F.col("source"))).select(
        "rid", "size", "h", "source_no", "source_size", "source_rows", "quota")
    placed = materialise(positions(placed.filter("size > 0")), "mix-places")
    spare = F.col("quota") - F.col("pos") - F.col("size")
    copies = F.sequence(F.lit(0), F.floor(spare / F.col("source_size")).cast("int"))
    streamed = placed.filter(spare >= 0).select("*", F.explode(copies).alias("copy"))
    at = F.col("copy") * F.col("source_size") + F.col("pos")
    copied = (streamed.withColumn("block", F.floor(at / block_words)).select("rid", "h", "copy", "source_no", "block", "size")
              .unionByName(_filled(placed, streamed, goals, block_words)))
    dealt = quotas(spark, blocks, shards, seed)
    dealt = dealt.select("shard", "source_no", F.explode(F.expr("sequence(first, first + count - 1)")).alias("turn"))
    step = (F.col("turn").cast("decimal(38,0)") * F.col("step") + seed) % F.col("blocks")
    dealt = (dealt.join(steps, "source_no")
             .select("source_no", "shard", step.cast("long").alias("block")))
    return copied.join(dealt, ["source_no", "block"]).select("rid", "copy", "shard", "size", "h"), goals


def _filled(placed: DataFrame, streamed: DataFrame, goals: DataFrame, block_words: int) -> DataFrame:
    """(rid, h, copy, source_no, block, size) of the documents that fill the gap at the end of each source's stream."""
    sums = streamed.groupBy("source_no").agg(F.sum("size").alias("words"))
    words_taken = F.coalesce("words", F.lit(0))
    gaps = goals.join(sums, "source_no", "left").filter("source_size > 0").select(
        "source_no", "quota", (F.col("quota") - words_taken).alias("gap"),
        F.floor(words_taken / F.col("source_size")).cast("int").alias("copy"), (words_taken % F.col("source_size")).alias("reached"))
    gaps, chosen = materialise(gaps, "mix-gaps"), None  # one row per source
    for k in range(FILL_ROUNDS):
        left = placed.select("rid", "h", "source_no", "pos", "size").join(gaps, "source_no").filter("gap > 0")
        left = left.withColumn("copy", F.col("copy") + (F.col("pos") < F.col("reached")).cast("int")).filter(F.col("copy") < MOST_COPIES)
        left = left.filter(F.abs(F.col("size") - F.col("gap")) < F.col("gap") if k + 1 == FILL_ROUNDS else F.col("size") <= F.col("gap"))
        if chosen is not None:
            left = left.join(chosen.select("rid"), "rid", "left_anti")
        best = F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "h", "rid", "size", "copy", "quota"))
        pick = materialise(left.groupBy("source_no").agg(best.alias("b")).select("source_no", "b.*"), "mix-pick")
        chosen = pick if chosen is None else chosen.unionByName(pick)
        used = pick.select("source_no", F.col("size").alias("used"))
        gaps = gaps.join(used, "source_no", "left").withColumn("gap", F.col("gap") - F.coalesce("used", F.lit(0))).drop("used")
        gaps = materialise(gaps, "mix-gaps")
    return chosen.select("rid", "h", "copy", "source_no", F.floor((F.col("quota") - 1) / block_words).alias("block"), "size")


def mixed(docs: DataFrame, seed: int = SEED, **sizes: int) -> DataFrame:
    """(row, shard, place): the rows of ``docs``, packed, each as often as the mix takes it."""
    rows = numbered(docs, "mix-docs")
    light = rows.select("rid", F.col("row.source").cast("string").alias("source"), words(F.col("row.text")).alias("size"),
                        F.xxhash64(F.lit(seed), "row.doc_id", "row.text").alias("h"))
    light = materialise(light, "mix-rows")
    taken, _ = draws(light, seed, **sizes)
    order = F.xxhash64(F.lit(seed), "shard", "h", "copy")  # the shuffle inside a shard, before the texts join
    place = F.row_number().over(Window.partitionBy("shard").orderBy(order, "rid", "copy"))
    return rows.join(taken.withColumn("place", place), "rid").select("row", "shard", "place")


def mix(docs: DataFrame, seed: int = SEED, **sizes: int) -> DataFrame:
    """The mixed rows with the columns of ``docs`` alone: a document stands as often as the mix takes it."""
    return unpacked(mixed(docs, seed, **sizes), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: per document, the words that the mix takes."""
    docs = table(spark, sf_dir, "documents")
    rows = materialise(docs.select("doc_id", F.col("source"), words(F.col("text")).alias("size"), F.xxhash64(F.lit(SEED), "doc_id", "text").alias("h"))
                       .withColumn("rid", F.monotonically_increasing_id()), "mix-rows")
    taken, goals = draws(rows)
    per_doc = taken.groupBy("rid").agg(F.sum("size").alias("taken"))
    goals = goals.withColumnRenamed("source", "s")
    return (rows.join(per_doc, "rid", "left")
            .join(goals, F.col("s").eqNullSafe(F.col("source")))
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))
