"""Hard-negative mining (operator 11): a BOND scan over columnar blocks of vectors.

Rows are dealt to tasks by (part of the rows, group of the anchors); a task holds the anchors of its group and
streams its rows, each Arrow batch as a block with one column a dimension. For an anchor the block's columns are
read in descending order of the anchor's magnitudes, STEP at a time, into partial products. What the columns not yet
read can add lies between the sums of their least and greatest contributions (from each column's least and greatest
value in the block), so every row has a lower and an upper bound; rows that can't matter leave the candidate bitmap.
The first scan finds the best rows of the anchor's label: a row goes when its upper bound is below the k-th best
lower bound, of the block or of exact products seen before. Their products make the windows of the second scan: a
row of another label goes when its bounds meet no window, or no window above the k-th best product in it so far.
What stays to the end has its exact product. Each task reports k rows for each anchor and window, merged in Spark.

All products are integers: doubles where they are exact, or else Python's integers without bounds; a product beyond
the range of a long counts as the end of that range.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; a missing
component (vectors of several lengths) counts as zero; a null id stands last among ties; repeated rows are rows of
their own, an anchor's copies among its positives; a table without anchors gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import table

#: Fixed values of the contract.
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100
SCALE = 256

#: Rows of a part, parts at least, anchors of a group.
PART_ROWS = 200_000
LEAST_PARTS = 12
GROUP_ROWS = 2048
#: Dimensions read between two looks at the bounds.
STEP = 8

EXACT = 1 << 53
LONG = np.iinfo(np.int64)
ID = np.dtype([("none", bool), ("id", np.int64)])


def usable(label: Column, vector: Column) -> Column:
    """Whether a row takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return label.isNotNull() & vector.isNotNull() & ~bad


def integers(vector: Column) -> Column:
    """Each component as floor(SCALE * x), a long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))


class _Block:
    """Rows of one vector length by column, with each column's least and greatest value."""

    def __init__(self, at: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.at, self.ids, self.labels = at, ids, labels
        self.whole = np.ascontiguousarray(vectors.T)
        self.least, self.most = self.whole.min(1, initial=LONG.max), self.whole.max(1, initial=LONG.min)
        self.far = max((abs(int(x)) for x in (*self.least, *self.most)), default=0)
        self.columns = self.whole.astype(float) if self.far < EXACT else self.whole.astype(object)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, shrink) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the bitmap ``alive`` that ``shrink(lower, upper)`` never drops, and their exact products."""
        d = min(len(anchor), len(self.columns))
        anchor = anchor[:d]
        if d * self.far * max((abs(int(x)) for x in anchor), default=0) >= EXACT:
            rows = np.flatnonzero(alive)
            exact = anchor.astype(object) @ self.whole[:d][:, rows].astype(object) if d else np.zeros(len(rows), object)
            return rows, np.array([min(max(int(x), LONG.min), LONG.max) for x in exact], np.int64)
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order].astype(float)
        ends = np.stack([a * self.least[order], a * self.most[order]])
        low = np.append(ends.min(0)[::-1].cumsum()[::-1], 0)
        high = np.append(ends.max(0)[::-1].cumsum()[::-1], 0)
        rows = np.flatnonzero(alive)
        partial = np.zeros(len(rows))
        for k in range(0, d, STEP):
            dims = order[k:k + STEP]
            if 2 * len(rows) > len(alive):
                partial += (a[k:k + STEP] @ self.columns[dims])[rows]
            else:
                partial += a[k:k + STEP] @ self.columns[np.ix_(dims, rows)]
            left = min(k + STEP, d)
            stay = shrink(partial + low[left], partial + high[left])
            rows, partial = rows[stay], partial[stay]
            if not len(rows):
                break
        return rows, partial.astype(np.int64)


class _Best:
    """The k best (product, id) so far: greater products first, then smaller ids, no id last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, ID)

    def floor(self) -> float:
        """A product below this can't enter."""
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        if len(scores) > self.k:
            top = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[top], ids[top]
        order = np.lexsort((ids["id"], ids["none"], ~scores))[:self.k]  # ~ turns the order
        self.scores, self.ids = scores[order], ids[order]


def _blocks(batch: pa.RecordBatch) -> Iterator[_Block]:
    """A block for each vector length of the batch."""
    vectors = batch.column("v")
    lengths = vectors.value_lengths().to_numpy()
    values, starts = vectors.values.to_numpy(), vectors.offsets.to_numpy()[:-1].astype(np.int64)
    at, labels = batch.column("at").to_numpy(), batch.column("label").to_numpy()
    ids = np.zeros(len(at), ID)
    ids["none"] = batch.column("id").is_null().to_numpy(zero_copy_only=False)
    ids["id"] = batch.column("id").fill_null(0).to_numpy()
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield _Block(at[rows], ids[rows], labels[rows], values[starts[rows, None] + np.arange(n)])


class _Positives:
    """First scan: an anchor's best rows of its own label."""

    def __init__(self, anchor: dict, k: int):
        self.at, self.label, self.v = anchor["at"], anchor["label"], np.array(anchor["v"], np.int64)
        self.best = [_Best(k)]

    def look(self, block: _Block) -> None:
        best, alive = self.best[0], (block.labels == self.label) & (block.at != self.at)

        def shrink(lower, upper):
            least = best.floor()
            if len(lower) > best.k:
                least = max(least, np.partition(lower, len(lower) - best.k)[len(lower) - best.k])
            return upper >= least

        if alive.any():
            rows, scores = block.scan(self.v, alive, shrink)
            best.add(scores, block.ids[rows])


class _Negatives:
    """Second scan: the best rows of other labels in the window of each positive."""

    def __init__(self, anchor: dict, k: int, low: int, high: int):
        self.at, self.label, self.v = anchor["at"], anchor["label"], np.array(anchor["v"], np.int64)
        self.windows = [(-(-low * s // 100), high * s // 100) for s in anchor["windows"]]
        self.best = [_Best(k) for _ in self.windows]

    def look(self, block: _Block) -> None:
        alive = block.labels != self.label

        def shrink(lower, upper):
            stay = np.zeros(len(lower), bool)
            for (low, high), best in zip(self.windows, self.best, strict=True):
                stay |= (upper >= max(low, best.floor())) & (lower <= high)
            return stay

        if alive.any():
            rows, scores = block.scan(self.v, alive, shrink)
            for (low, high), best in zip(self.windows, self.best, strict=True):
                inside = (scores >= low) & (scores <= high)
                best.add(scores[inside], block.ids[rows[inside]])


def _scanned(rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int], search) -> DataFrame:
    """(anchor, place, score, id): of each task, what ``search(anchor)`` found in its rows; place is the window's."""
    parts, groups = max(LEAST_PARTS, -(-sizes[0] // PART_ROWS)), max(1, -(-sizes[1] // GROUP_ROWS))
    part = F.pmod(F.xxhash64(F.lit(0), "at"), F.lit(parts)).cast("int")
    group = F.pmod(F.xxhash64(F.lit(1), "at"), F.lit(groups)).cast("int")
    columns = ["at", "id", "label", "v", "windows"]
    of_row = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: part * groups + g)
    of_anchor = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: p * groups + group)
    empty = F.array().cast("array<bigint>").alias("windows")
    dealt = (anchors.select(F.explode(of_anchor).alias("task"), F.lit(0).alias("kind"), *columns)
             .unionByName(rows.select("*", empty).select(F.explode(of_row).alias("task"), F.lit(1).alias("kind"), *columns))
             .repartitionById(parts * groups, "task").sortWithinPartitions("kind"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:  # the anchors come first
            kind = batch.column("kind").to_numpy()
            n = int((kind == 0).sum())
            held += [search(a) for a in batch.slice(0, n).to_pylist()]
            for block in _blocks(batch.slice(n)):
                for one in held:
                    one.look(block)
        for k in range(0, len(held), 512):
            found = [(one.at, place, int(s), None if i["none"] else int(i["id"])) for one in held[k:k + 512]
                     for place, best in enumerate(one.best) for s, i in zip(best.scores, best.ids, strict=True)]
            columns = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
                pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor", "place", "score", "id"])

    return dealt.mapInArrow(scan, "anchor long, place int, score long, id long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and window, with their ranks."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
                   high: int = HIGH) -> DataFrame:
    """For each anchor and each of its positives, the hardest rows of another label inside the window.

    ``rows``: (id long, label long, v array<long>, anchor boolean). The window of a positive holds the products of
    ``low`` to ``high`` percent of its own.
    """
    rows = materialise(rows.select("id", "label", "v", "anchor", F.monotonically_increasing_id().alias("at")), "vectors")
    anchors = rows.filter("anchor").drop("anchor")
    rows = rows.drop("anchor")
    sizes = rows.count(), anchors.count()
    none = F.array().cast("array<bigint>")
    near = _first(_scanned(rows, anchors.withColumn("windows", none), sizes, lambda a: _Positives(a, positives)), positives)
    near = materialise(near, "positives")
    scores = F.sort_array(F.collect_list(F.struct("rank", "score")))  # at most ``positives`` of them
    windows = near.groupBy("anchor").agg(scores.getField("score").alias("windows"))
    anchors = anchors.join(windows, F.col("at") == F.col("anchor")).drop("anchor")
    hard = _first(_scanned(rows, anchors, sizes, lambda a: _Negatives(a, negatives, low, high)), negatives)
    own = near.select("anchor", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"),
                      F.col("score").alias("positive_score"))
    name = rows.select(F.col("at").alias("anchor"), F.col("id").alias("anchor_id"))
    return (hard.join(own, ["anchor", "place"]).join(name, "anchor")
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: hard negatives of the embeddings whose id is divisible by 100; labels of every seventh id are moved."""
    vec_id, vector, label = F.col("vec_id").cast("long"), F.col("embedding"), F.col("label").cast("long")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = table(spark, sf_dir, "embeddings").filter(usable(label, vector)).select(
        vec_id.alias("id"), moved.alias("label"), integers(vector).alias("v"),
        F.coalesce(vec_id % 100 == 0, F.lit(False)).alias("anchor"))
    return hard_negatives(rows)


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS vec_id,
         list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
