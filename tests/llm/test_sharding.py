"""Sharding against a plain sort by the same key."""

import zlib
from collections import Counter, defaultdict

import pytest
from xxhash import xxh64_intdigest

from aislelens.llm import sharding
from aislelens.llm.common import table
from aislelens.session import materialise

from . import cases


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def check(docs, shards=8, tolerance=0.001):
    """The sharded rows; each boundary is as near to its share as rows and tolerance allow."""
    rows = sharding.sharded(docs, shards, tolerance).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        assert r.size == len((r.row.text or "").encode()) + 1
        by[r.shard].append((r.slot, signed(xxh64_intdigest((r.row.text or "").encode(), 42)), r))
    assert set(by) <= set(range(shards))
    total, below, last = sum(r.size for r in rows), 0, None
    for k in range(shards):
        part = sorted(by[k], key=lambda x: x[0])
        assert [x[0] for x in part] == list(range(len(part)))
        keys = [x[1] for x in part]
        assert keys == sorted(keys) and (last is None or not keys or keys[0] >= last)
        last = keys[-1] if keys else last
        below += sum(x[2].size for x in part)
        at = [x for j in range(k + 1) for x in sorted(by[j], key=lambda x: x[0])][-1:]
        at += [x for j in range(k + 1, shards) for x in sorted(by[j], key=lambda x: x[0])][:1]
        edge = max((x[2].size for x in at), default=0)
        assert abs(below - total * (k + 1) / shards) <= max(tolerance * total / shards, edge), k
    return rows


def test_odd_rows(spark):
    docs = cases.frame(spark)
    rows = check(docs)
    assert sorted(map(cases.key, (tuple(r.row) for r in rows))) == sorted(map(cases.key, cases.rows()))


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_whole_table(spark, shards):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = check(docs, shards)
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows)


def test_groups_stay_together_unless_too_large(spark):
    texts = [f"text {k} " * 5 for k in range(300)]
    hot = "copy " * 10
    rows = [(k, t) for k, t in enumerate(texts * 3)] + [(5000 + k, hot) for k in range(700)]
    docs = materialise(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "groups")
    out = check(docs, tolerance=0.05)
    shards = defaultdict(set)
    for r in out:
        shards[r.row.text].add(r.shard)
    assert len(shards[hot]) >= 3  # over a third of all bytes
    assert all(len(v) == 1 for t, v in shards.items() if t != hot)


def test_one_repeated_row(spark):
    docs = spark.createDataFrame([(None, "same")] * 800, "doc_id long, text string")
    out = check(docs)
    assert Counter(r.shard for r in out) == {k: 100 for k in range(8)}


def test_empty(spark):
    assert sharding.sharded(cases.empty(spark)).count() == 0


def test_query(spark):
    docs = {r.doc_id: r for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    out = sharding.query(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        text = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "bytes", None)
