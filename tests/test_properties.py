"""Property tests: exact rounding, the distributed top-share cut, blocked
top-k, against brute force."""

from fractions import Fraction

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aislelens.functions.exact import round_ratio
from aislelens.operators import churn, retrieval

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def half_up(num, den, places):
    q = Fraction(num, den) * 10 ** places
    return float(int(q + Fraction(1, 2))) / 10 ** places


@SLOW
@given(st.lists(st.tuples(st.integers(0, 10 ** 9), st.integers(1, 10 ** 6)), min_size=1, max_size=40),
       st.integers(0, 4))
def test_round_ratio_is_exact_half_up(spark, pairs, places):
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [r[0] for r in df.select(round_ratio(F.col("n"), F.col("d"), places)).collect()]
    assert got == [half_up(n, d, places) for n, d in pairs]


@SLOW
@given(st.lists(st.sampled_from([0, 1, 5, 30, 31, 90, 999]), min_size=1, max_size=120),
       st.randoms(use_true_random=False))
def test_top_share_equals_global_rank(spark, recency, rnd):
    ids = rnd.sample(range(10 ** 6), len(recency))
    df = spark.createDataFrame(list(zip(ids, recency)), "customer_id long, recency_days int")
    got = {r["customer_id"]: r["churn_label"] for r in churn.churn_label(df).collect()}
    k = max(2, int(len(ids) * 0.30))
    ranked = sorted(zip(ids, recency), key=lambda t: (-t[1], t[0]))
    want = {cid: int(i < k) for i, (cid, _) in enumerate(ranked)}
    assert got == want


def test_top_share_handles_a_dominant_tie_bucket(spark):
    # 2/3 of the rows share one value; the cut falls inside that bucket
    data = [(i, 999) for i in range(0, 3000, 3)] + [(i, 5) for i in range(1, 1500, 3)]
    df = spark.createDataFrame(data, "customer_id long, recency_days int")
    labels = {r["customer_id"]: r["churn_label"] for r in churn.churn_label(df).collect()}
    k = int(len(data) * 0.30)
    want = sorted(data, key=lambda t: (-t[1], t[0]))[:k]
    assert {c for c, l in labels.items() if l == 1} == {c for c, _ in want}


@SLOW
@given(st.integers(1, 12), st.integers(1, 60), st.integers(1, 6), st.integers(0, 2 ** 16))
def test_blocked_top_k_equals_brute_force(spark, nq, nc, k, seed):
    rng = np.random.default_rng(seed)
    qv = rng.integers(-2, 3, size=(nq, 4)).astype(float)       # small ints -> many exact ties
    cv = rng.integers(-2, 3, size=(nc, 4)).astype(float)
    qv[np.all(qv == 0, axis=1)] = 1.0
    cv[np.all(cv == 0, axis=1)] = 1.0
    q = spark.createDataFrame([(i, qv[i].tolist()) for i in range(nq)], "query_id long, vector array<double>")
    c = spark.createDataFrame([(100 + j, cv[j].tolist()) for j in range(nc)], "doc_id long, vector array<double>")
    hits = retrieval.top_k(q, c, k, query_block_bytes=200)
    got = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in hits.collect())
    want = []
    for i in range(nq):
        s = [(-float(qv[i] @ cv[j] / np.linalg.norm(qv[i]) / np.linalg.norm(cv[j])), 100 + j) for j in range(nc)]
        s = [(round(a, 12), b) for a, b in s]
        for r, (_, j) in enumerate(sorted(s)[:k]):
            want.append((i, r + 1, j))
    assert got == sorted(want)


@SLOW
@given(st.dictionaries(st.integers(0, 30), st.sampled_from(["a", "b", None]), max_size=20),
       st.dictionaries(st.integers(0, 30), st.sampled_from(["a", "b", None]), max_size=20))
def test_change_feed_applied_to_old_gives_new(spark, old, new):
    from aislelens.operators import corpus

    schema = "doc_id long, document string"
    o = spark.createDataFrame(sorted(old.items()), schema)
    n = spark.createDataFrame(sorted(new.items()), schema)
    feed = corpus.changes(o, n, "doc_id", ["document"])
    got = sorted(tuple(r) for r in corpus.apply_changes(o, feed, "doc_id", ["document"]).collect())
    assert got == sorted(new.items())
    assert feed.count() == sum(1 for k in set(old) | set(new) if old.get(k, "x") != new.get(k, "x")
                               or (k in old) != (k in new))
