"""The inverted-list index and top_k against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aislelens.operators import retrieval, vector_index
from aislelens.sources.adapter import Source
from tests.conftest import SMOKE


def made(n, dim=16, clusters=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    v = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * 0.3
    return np.round(v * 64).astype(int)  # integer vectors: products are exact


def frame(spark, vectors, ids, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors)], f"{name} string, vector array<double>")


def brute(q, c, q_ids, c_ids, k):
    s = (q @ c.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1))
    return {(q_ids[i], c_ids[j]) for i in range(len(q)) for j in sorted(range(len(c)), key=lambda j: (-round(s[i, j], 12), c_ids[j]))[:k]}


def test_index_recall_and_the_exact_way(spark):
    c = made(1500)
    c_ids = [f"d{k:05d}" for k in range(len(c))]
    corpus = frame(spark, c, c_ids, "doc_id").unionByName(
        spark.createDataFrame([("zero", [0.0] * 16), ("none", None)], "doc_id string, vector array<double>"))
    q, q_ids = c[::50], [f"q{k}" for k in range(len(c[::50]))]
    queries = frame(spark, q, q_ids, "query_id")
    index = vector_index.build(spark, corpus)
    assert index.lists > 8 and index.rows.count() == 1500 and index.probes < index.lists
    want = brute(q, c, q_ids, c_ids, 5)
    exact = {(r.query_id, r.doc_id) for r in vector_index.search(index, queries, 5, probes=index.lists).collect()}
    assert len(want & exact) >= len(want) - 2  # equal cosines may round apart
    found = {(r.query_id, r.doc_id) for r in vector_index.search(index, queries, 5).collect()}
    assert len(want & found) >= 0.9 * len(want)
    ranks = vector_index.search(index, queries, 5).groupBy("query_id").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert all(list(r.r) == [1, 2, 3, 4, 5] for r in ranks)


def test_a_hot_list_is_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "CHUNK_ROWS", 60)
    c = np.concatenate([made(200), np.tile([64] + [0] * 15, (400, 1))])
    c_ids = [f"d{k:05d}" for k in range(len(c))]
    index = vector_index.build(spark, frame(spark, c, c_ids, "doc_id"))
    assert max(r.n for r in index.rows.groupBy("list", "chunk").agg(F.count("*").alias("n")).collect()) < 120
    queries = frame(spark, c[-150:], [f"q{k}" for k in range(150)], "query_id")
    hits = vector_index.search(index, queries, 3).collect()
    assert len(hits) == 450 and {r.doc_id for r in hits} == {"d00200", "d00201", "d00202"}


def test_empty(spark):
    index = vector_index.build(spark, spark.createDataFrame([], "doc_id string, vector array<double>"))
    assert vector_index.search(index, spark.createDataFrame([("q", [1.0])], "query_id string, vector array<double>")).count() == 0


@pytest.mark.parametrize("block", [3000, 6000, 1 << 20])
def test_top_k_by_task_equals_the_broadcast(spark, block):
    c, q = made(700), made(90, seed=2)
    corpus = frame(spark, c, [f"d{k:05d}" for k in range(len(c))], "doc_id")
    queries = frame(spark, q, [f"q{k:03d}" for k in range(len(q))], "query_id")
    got = retrieval.top_k(queries, corpus, 5, query_block_bytes=block).collect()
    want = retrieval.top_k(queries, corpus, 5).collect()
    assert {(r.query_id, r.doc_id, r.rank) for r in got} == {(r.query_id, r.doc_id, r.rank) for r in want}
    assert len(got) == 450


def test_many_queries_are_not_broadcast(spark, monkeypatch):
    emb = Source(spark, SMOKE).table("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    monkeypatch.setattr(retrieval, "_beside_broadcast", None)  # a call would fail
    hits = retrieval.top_k(emb.withColumnRenamed("vec_id", "query_id"), emb, 2, c_id="vec_id", query_block_bytes=10_000)
    assert hits.filter("rank = 1").filter("query_id = vec_id").count() == emb.count()


def test_a_task_holds_no_more_for_ties_and_large_batches():
    import tracemalloc

    ids, rows = np.arange(400), np.tile([0.0, 1.0], (10_000, 1))
    c_ids = np.array([f"d{k:05d}" for k in reversed(range(len(rows)))], dtype=object)
    tracemalloc.start()
    best = retrieval._Best(ids, np.tile([1.0, 0.0], (400, 1)), 3, "query_id", "doc_id")  # all scores are 0
    best.add(c_ids, pd.Series(list(rows)))
    got = best.rows()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20  # 4,000,000 pairs tie; as rows they took 600 MB
    assert got["doc_id"].tolist() == ["d00000", "d00001", "d00002"] * 400


def test_tiles_and_batches_leave_the_best(monkeypatch):
    monkeypatch.setattr(retrieval, "TILE_CELLS", 70)
    monkeypatch.setattr(retrieval, "LOOSE_ROWS", 5)
    rng = np.random.default_rng(5)
    q, c = rng.integers(-1, 2, (9, 3)).astype(float), rng.integers(-1, 2, (300, 3)).astype(float)
    best = retrieval._Best(np.arange(9), q, 4, "query_id", "doc_id")
    for at in range(0, 300, 37):
        best.add(np.arange(at, min(at + 37, 300)), pd.Series(list(c[at:at + 37])))
    with np.errstate(all="ignore"):
        s = (q @ c.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1))
    s = np.where(np.isfinite(s), s, -np.inf)
    want = [(i, j) for i in range(9) for j in sorted(range(300), key=lambda j: (-s[i, j], j))[:4]]
    assert list(map(tuple, best.rows()[["query_id", "doc_id"]].to_numpy().tolist())) == want


def sparse(n, dim, share, seed):
    rng = np.random.default_rng(seed)
    return rng.integers(-1, 4, (n, dim)) * (rng.random((n, dim)) < share) * 1.0


def best_pairs(q, c, k):
    with np.errstate(all="ignore"):
        s = (q @ c.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1))
    s = np.where(np.isfinite(s), s, -np.inf)
    return [(i, j) for i in range(len(q)) for j in sorted(range(len(c)), key=lambda j: (-s[i, j], j))[:k]]


@pytest.mark.parametrize("seed", range(4))
def test_sparse_blocks_leave_the_best(monkeypatch, seed):
    monkeypatch.setattr(retrieval, "FIRST_ROWS", 20)
    monkeypatch.setattr(retrieval, "LOOSE_ROWS", 5)
    q, c = sparse(12, 60, 0.1, seed), sparse(400, 60, 0.08, seed + 9)
    q[3], c[7] = 0, 0  # no cosine; many others tie
    best = retrieval._Best(np.arange(12), q, 4, "query_id", "doc_id")
    monkeypatch.setattr(best, "_tile", None)  # a call would fail
    order = np.random.default_rng(seed).permutation(400)
    for at in range(0, 400, 150):
        here = order[at:at + 150]
        best.add(here, retrieval._Sparse.of(c[here]) if seed % 2 else pd.Series(list(c[here])))
    assert list(map(tuple, best.rows()[["query_id", "doc_id"]].to_numpy().tolist())) == best_pairs(q, c, 4)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_are_dealt_once_however_many_tasks_meet_them(spark, monkeypatch, kind):
    monkeypatch.setattr(retrieval, "CORPUS_PART_ROWS", 100)
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 2000)
    q, c = sparse(90, 40, 0.2, 1), sparse(700, 40, 0.1, 2)
    queries = frame(spark, q, [f"q{k:03d}" for k in range(90)], "query_id").withColumn("vector", F.col("vector").cast(f"array<{kind}>"))
    corpus = frame(spark, c, [f"d{k:03d}" for k in range(700)], "doc_id").withColumn("vector", F.col("vector").cast(f"array<{kind}>"))
    dealt = retrieval._packed(corpus, F.lit(0), "c", retrieval.BLOCK_BYTES).selectExpr(
        "size(_c_ids) AS rows", "coalesce(length(_c_counts), 0) + coalesce(length(_c_at), 0) + length(_c_values) AS bytes").collect()
    assert sum(r.rows for r in dealt) == 700 and len(dealt) > 1
    assert sum(r.bytes for r in dealt) <= np.count_nonzero(c) * (8 if kind == "float" else 12) + 700 * 4
    hits = retrieval.top_k(queries, corpus, 5, query_block_bytes=3000)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "shuffle_replicate_nl" in plan  # a copy for each task would be exploded
    assert sorted((int(r.query_id[1:]), r.rank, int(r.doc_id[1:])) for r in hits.collect()) == [
        (i, n % 5 + 1, j) for n, (i, j) in enumerate(best_pairs(q, c, 5))]
