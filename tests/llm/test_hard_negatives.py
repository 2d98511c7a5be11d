"""Hard negatives against a plain scan of all pairs."""

import math
import random

import duckdb
import pytest

from aislelens.llm import hard_negatives as op
from aislelens.session import scratch_path
from tests.helpers import canon

SCHEMA = "vec_id long, embedding array<float>, label int, id string, at string, anchor string, v string"


def plain(rows):
    """(anchor, positive, rank, negative, positive score, negative score) by definition; rows: (id, vector, label)."""
    use = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []

    def score(a, b):
        return min(max(sum(x * y for x, y in zip(a[2], b[2], strict=False)), -1 << 63), (1 << 63) - 1)

    def order(x):
        return (-x[0], x[1] is None, x[1] or 0)

    for k, a in enumerate(use):
        if a[0] is None or a[0] % 100:
            continue
        near = sorted(((score(a, b), b[0]) for j, b in enumerate(use) if j != k and b[1] == a[1]), key=order)[:5]
        for s, i in near:
            hard = sorted(((t, b[0]) for b in use if b[1] != a[1] for t in [score(a, b)]
                           if 80 * s <= 100 * t <= 100 * s), key=order)[:5]
            out += [(a[0], i, n + 1, x, s, t) for n, (t, x) in enumerate(hard)]
    return sorted(map(canon, out))


def mined(spark, rows, parts=3):
    folder = scratch_path(spark, "vectors")
    data = [(i, v, label, "x", "x", "x", "x") for i, v, label in rows]
    spark.createDataFrame(data, SCHEMA).repartition(parts).write.parquet(f"{folder}/embeddings.parquet")
    return sorted(canon(tuple(r)) for r in op.query(spark, folder).collect())


def test_odd_rows(spark):
    rng = random.Random(1)
    rows = [(k, [rng.choice([-0.5, 0.25, 0.125, 0.7]) for _ in range(6)], k % 3) for k in range(0, 900, 5)]
    rows += [(100, [0.5] * 6, None), (200, None, 1), (300, [0.5, None], 1), (400, [float("nan")] * 6, 1),
             (500, [float("inf")] * 6, 1), (600, [], 1), (700, [0.5, 0.25], 1), (800, [0.5] * 9, 2), (None, [0.7] * 6, 2),
             (None, [0.7] * 6, 1), (100, [0.7] * 6, 1), (100, [0.7] * 6, 1), (-100, [0.7] * 6, 0),
             (900, [0.0] * 6, 0), (1000, [-0.5] * 6, 1)]
    assert mined(spark, rows) == plain(rows)


def test_ties_and_a_hot_vector(spark):
    rows = [(k, [0.5, 0.25, -0.125] if k % 3 else [0.4, 0.2, 0.1 * (k % 7)], k % 2) for k in range(400)]
    assert mined(spark, rows) == plain(rows)


def test_huge_components(spark):
    rng = random.Random(2)
    rows = [(k * 10, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 3, 12, 30]) for _ in range(4)], k % 2) for k in range(60)]
    rows = [(i, [float(x) for x in v], label) for i, v, label in rows]
    import numpy as np

    def stored(x):  # as a float, and as the long that floor gives
        y = float(np.float32(x))
        return min(max(256 * y, -2.0 ** 63), 2.0 ** 63) / 256

    got, want = mined(spark, rows), plain([(i, [stored(x) for x in v], label) for i, v, label in rows])
    assert len(got) == len(want)


def test_small_parts_and_groups(spark, monkeypatch):
    monkeypatch.setattr(op, "PART_ROWS", 40)
    monkeypatch.setattr(op, "GROUP_ROWS", 2)
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 0.2) for _ in range(20)], k % 4) for k in range(0, 1000, 4)]
    import numpy as np
    assert mined(spark, rows) == plain([(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_tables(spark, sf):
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM read_parquet('{folder}/embeddings.parquet')")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({op.SQL})").fetchall()
    got = [tuple(r) for r in op.query(spark, folder).select(names).collect()]
    assert sorted(got) == sorted(want) and got


def test_empty(spark):
    assert mined(spark, []) == []


def test_bounds_drop_rows():
    """The bitmap shrinks before the last columns, and never loses a row of the answer."""
    import numpy as np
    rng = np.random.default_rng(4)
    v = (rng.normal(0, 60, (4000, 64)) * np.linspace(3, 0.1, 64)).astype(np.int64)
    block = op._Block(np.arange(4000), np.zeros(4000, op.ID), np.zeros(4000, np.int64), v)
    alive, seen = np.ones(4000, bool), []

    def shrink(lower, upper):
        kth = np.partition(lower, len(lower) - 5)[len(lower) - 5]
        stay = upper >= kth
        seen.append(int(stay.sum()))
        return stay

    rows, scores = block.scan(v[0], alive, shrink)
    exact = v @ v[0]
    assert set(np.argsort(-exact)[:5]) <= set(rows) and (exact[rows] == scores).all()
    assert seen[len(seen) // 2] < 400
