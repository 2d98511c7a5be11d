import re
from collections import Counter

import numpy as np
import pytest

from aislelens.llm import mixing

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 80, "é": 3, "z": 400}, {"a": 7}, {"a": 0, "b": 9},
                                   {f"s{k}": (k * 37) % 11 + 1 for k in range(40)}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(expected_targets(sizes))


def test_split_is_exact_and_fair():
    counts, shards = np.array([100, 0, 7, 33], np.int64), 7
    left, right, k = mixing._split(counts, shards, 1, 7)
    assert (left + right == counts).all() and (left >= 0).all() and (right >= 0).all()
    assert left.sum() == counts.sum() * k // shards
    assert (mixing._split(counts, shards, 1, 7)[0] == left).all()


def test_quotas_cover_every_block_once(spark):
    rows = mixing.quotas(spark, [50, 0, 1000, 3], 200, 7).collect()
    for source, n in ((1, 50), (3, 1000), (4, 3)):
        own = sorted((r["first"], r["count"]) for r in rows if r.source_no == source)
        assert [a for a, _ in own] == np.cumsum([0, *[c for _, c in own]]).tolist()[:-1] and sum(c for _, c in own) == n
    assert max(Counter(r.shard for r in rows).values()) <= 3 and {r.shard for r in rows} <= set(range(200))


def test_mix_takes_the_targets(spark):
    docs = cases.frame(spark)
    size, largest = Counter(), Counter()
    for r in cases.rows():
        n = len(WORD.findall(r[1] or ""))
        size[r[3]] += n
        largest[r[3]] = max(largest[r[3]], n)
    goal = expected_targets(size)
    mixed = mixing.mixed(docs, block_words=500, shard_words=5000).collect()
    out = [r.row for r in mixed]
    got = Counter()
    for r in out:
        got[r.source] += len(WORD.findall(r.text))
    for s in size:
        assert abs(got[s] - goal[s]) <= largest[s] / 2 + 1
    assert {tuple(r) for r in out} <= set(cases.rows())  # whole rows, with their own shard and place
    assert max(Counter((r.doc_id, r.text) for r in out).values()) <= 6  # three times, for a row that stands twice
    again = mixing.mixed(cases.frame(spark, 7), block_words=500, shard_words=5000).collect()
    key = lambda r: cases.key((r.row.doc_id, r.row.text, r.shard, r.place))
    assert sorted(map(key, again)) == sorted(map(key, mixed))
    plain = mixing.mix(docs, block_words=500, shard_words=5000)
    assert plain.columns == docs.columns and plain.count() == len(out)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_comes_near_the_targets(spark, sf):
    rows = mixing.query(spark, f"/root/testdata/{sf}").collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    size, taken, most, target = Counter(), Counter(), Counter(), {}
    for r in rows:
        assert r.size == len(WORD.findall(docs[r.doc_id].text or "")) and r.taken <= 3 * r.size
        assert r.taken == 0 or r.taken % r.size == 0
        source = docs[r.doc_id].source
        size[source] += r.size
        most[source] = max(r.size, most[source])
        taken[source] += r.taken
        target[source] = r.target
    assert target == pytest.approx(expected_targets(size))
    for s, goal in target.items():
        # fifty documents a source fit the target well; ten leave a part of one of them
        assert abs(taken[s] - goal) <= (max(5, 0.01 * goal) if sf == "sf0.01" else most[s] / 2), (s, taken[s], goal)


def test_empty(spark):
    assert mixing.mix(cases.empty(spark)).count() == 0
