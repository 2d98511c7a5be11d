"""An inverted-list vector index for cosine search, stored clustered by list, with exact re-ranking.

``build`` fits a k-means quantiser on at most SAMPLE_ROWS rows (a hash sample; the bound is a parameter), assigns
every row to the list of its nearest centroid and writes the rows sorted by list. Lists longer than CHUNK_ROWS are
cut into chunks by a hash of the id, so a hot list is work for many tasks. It then measures on a sample of queries
how many lists must be probed for the wanted recall, and keeps that number with the index.

``search`` sends each query to the chunks of its nearest lists; a task streams the rows of a chunk past the queries
that it holds, at most CHUNK_ROWS of them, and reports k rows for each; a window merges these. Probing all lists is
the exact way. Rows and queries without a direction (null or zero vector) have no neighbours and are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..session import materialise
from .retrieval import top_k

SAMPLE_ROWS = 20_000
CALIBRATION_QUERIES = 64
CHUNK_ROWS = 50_000
LEAST_LIST = 20                   # rows of a list on average, at least
MOST_LISTS = 4096                 # bounds the centroids, which every task holds
RECALL = 0.95


def _unit(vec: str) -> Column:
    """The vector with length 1, or NULL if it has no direction."""
    v = F.col(vec).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(v, lambda x: x / norm))


@dataclass
class VectorIndex:
    """``rows``: (id, unit, list, chunk); ``sizes``: (list, chunks); ``centroids``: one unit vector a list."""

    rows: DataFrame
    sizes: DataFrame
    centroids: np.ndarray
    probes: int = 0

    @property
    def lists(self) -> int:
        return len(self.centroids)


def build(spark: SparkSession, corpus: DataFrame, c_id: str = "doc_id", vec: str = "vector", lists: int | None = None,
          recall: float = RECALL, k: int = C.RETRIEVAL_TOP_K, sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
    rows = materialise(corpus.select(F.col(c_id).alias("id"), _unit(vec).alias("unit")).filter("unit IS NOT NULL"), "index-rows")
    n = rows.count()
    lists = lists or int(min(MOST_LISTS, max(1, n ** 0.5, 1), max(1, n // LEAST_LIST)))
    share = int(min(1.0, sample_rows / max(n, 1)) * (1 << 20))
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < share)
    centroids = _centroids(sample, lists)
    found = rows.withColumn("list", _nearest(centroids, 1, F.col("unit")).getItem(0))
    counts = materialise(found.groupBy("list").agg(F.count(F.lit(1)).alias("n")), "index-lists")
    sizes = materialise(counts.select("list", F.ceil(F.col("n") / CHUNK_ROWS).cast("int").alias("chunks")), "index-sizes")
    placed = (found.join(F.broadcast(sizes), "list")  # at most MOST_LISTS rows
              .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks"))
    parts = max(1, -(-n // CHUNK_ROWS))
    stored = materialise(placed.repartitionByRange(parts, "list", "chunk", "id").sortWithinPartitions("list", "chunk"), "vector-index")
    index = VectorIndex(stored, sizes, centroids)
    index.probes = _calibrated(index, recall, k)
    return index


def _centroids(sample: DataFrame, lists: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = sample.select(array_to_vector("unit").alias("features"))
    if data.isEmpty():
        return np.zeros((1, 1))
    model = KMeans(k=max(lists, 2), seed=1, distanceMeasure="cosine", maxIter=10).fit(data)
    out = np.array(model.clusterCenters())
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _nearest(centroids: np.ndarray, probes: int, unit: Column) -> Column:
    """The lists of a vector's ``probes`` nearest centroids, nearest first (ties: the smaller list)."""
    @F.pandas_udf("array<int>")
    def lists(v: pd.Series) -> pd.Series:
        out = []
        for k in range(0, len(v), 1024):
            s = np.stack(v.iloc[k:k + 1024].to_list()) @ centroids.T
            out += np.argsort(-s, axis=1, kind="stable")[:, :probes].astype(np.int32).tolist()
        return pd.Series(out)

    return lists(unit)


def _calibrated(index: VectorIndex, recall: float, k: int) -> int:
    """The least number of lists (in powers of two, or all) that reaches the wanted recall on sampled rows."""
    n = index.rows.count()
    share = int(min(1.0, CALIBRATION_QUERIES / max(n, 1)) * (1 << 20)) + 1
    queries = materialise(index.rows.filter(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 20)) < share)
                          .select(F.col("id").alias("query"), F.col("unit").alias("vector")), "index-queries")
    if queries.isEmpty():
        return index.lists
    exact = materialise(search(index, queries, k, "query", "hit", index.lists), "index-exact")
    probes = 1
    while probes < index.lists:
        if _recall(exact, search(index, queries, k, "query", "hit", probes), "query", "hit") >= recall:
            return probes
        probes *= 2
    return index.lists


def _recall(exact: DataFrame, found: DataFrame, q_id: str, c_id: str) -> float:
    """The share of the exact hits that were found."""
    both = exact.select(q_id, c_id).join(found.select(q_id, c_id, F.lit(1).alias("there")), [q_id, c_id], "left")
    return both.agg(F.avg(F.coalesce("there", F.lit(0)))).first()[0] or 0.0


def search(index: VectorIndex, queries: DataFrame, k: int = C.RETRIEVAL_TOP_K, q_id: str = "query_id", c_id: str = "doc_id",
           probes: int | None = None, vec: str = "vector") -> DataFrame:
    """(q_id, c_id, score, rank): the k best rows of the probed lists for each query, by exact cosine."""
    probes = min(probes or index.probes or index.lists, index.lists)
    units = queries.select(F.col(q_id).alias("q"), _unit(vec).alias("unit")).filter("unit IS NOT NULL")
    probed = units.select("q", "unit", F.explode(_nearest(index.centroids, probes, F.col("unit"))).alias("list"))
    probed = materialise(probed.join(F.broadcast(index.sizes), "list"), "index-probes")
    asked = probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("groups"))
    asked = materialise(asked, "index-asked")  # at most MOST_LISTS rows
    group = F.pmod(F.xxhash64("q"), F.col("groups")).cast("int").alias("group")
    chunks = F.sequence(F.lit(0), F.col("chunks") - 1)
    held = (probed.join(F.broadcast(asked), "list").select("list", F.explode(chunks).alias("chunk"), group, F.lit(0).alias("kind"),
                                                          F.to_json(F.struct("q")).alias("key"), "unit"))
    rows = (index.rows.join(F.broadcast(asked), "list")
            .select("list", "chunk", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(1).alias("kind"),
                    F.to_json(F.struct("id")).alias("key"), "unit"))
    place = ["list", "chunk", "group"]
    dealt = held.unionByName(rows).repartition(*place).sortWithinPartitions(*place, "kind")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, units, tops = None, [], [], None
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in (*place, "kind")], 1)
            edges = np.flatnonzero((np.diff(where, axis=0) != 0).any(1)) + 1
            for a, b in zip([0, *edges], [*edges, len(where)], strict=True):
                part = batch.slice(a, b - a)
                vectors = np.stack(part.column("unit").to_numpy(zero_copy_only=False))
                if tuple(where[a, :3]) != now:
                    yield from _hits(keys, tops)
                    now, keys, units, tops = tuple(where[a, :3]), [], [], None
                if where[a, 3] == 0:
                    keys += part.column("key").to_pylist()
                    units.append(vectors)
                elif keys:
                    held = np.concatenate(units)
                    units = [held]
                    tops = _merged(tops, held @ vectors.T, np.array(part.column("key").to_pylist(), object), k)
        yield from _hits(keys, tops)

    q_type, c_type = queries.schema[q_id].dataType.simpleString(), index.rows.schema["id"].dataType.simpleString()
    found = dealt.mapInArrow(best, "q string, c string, score double").select(
        F.from_json("q", f"q {q_type}")["q"].alias(q_id), F.from_json("c", f"id {c_type}")["id"].alias(c_id), "score")
    order = Window.partitionBy(q_id).orderBy(F.desc("score"), F.asc(c_id))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _merged(tops, scores: np.ndarray, keys: np.ndarray, k: int):
    """For each query the rows at least as good as its k-th best so far, ties included."""
    out = []
    for i in range(len(scores)):
        s, c = (scores[i], keys) if tops is None else (np.concatenate([tops[i][0], scores[i]]), np.concatenate([tops[i][1], keys]))
        if len(s) > k:
            top = s >= np.partition(s, len(s) - k)[len(s) - k]
            s, c = s[top], c[top]
        if len(s) > k:  # of the ties, those with the smallest ids
            order = sorted(range(len(s)), key=lambda j: (-s[j], json.loads(c[j])["id"]))[:k]
            s, c = s[order], c[order]
        out.append((s, c))
    return out


def _hits(keys: list[str], tops) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys) if tops else 0, 1024):
        found = [(q, c, float(s)) for q, (ss, cs) in zip(keys[i:i + 1024], tops[i:i + 1024], strict=True)
                 for s, c in zip(ss, cs, strict=True)]
        columns = list(zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2])], ["q", "c", "score"])


def measured_recall(index: VectorIndex, queries: DataFrame, corpus: DataFrame, k: int, q_id: str, c_id: str) -> DataFrame:
    """One row (queries, hits, found): exact hits by brute force and how many of them the index finds."""
    exact = top_k(queries, corpus, k, q_id=q_id, c_id=c_id)
    found = search(index, queries, k, q_id, c_id).select(q_id, c_id, F.lit(1).alias("there"))
    return exact.select(q_id, c_id).join(found, [q_id, c_id], "left").agg(
        F.count_distinct(q_id).alias("queries"), F.count(F.lit(1)).alias("hits"), F.count("there").alias("found"))
