import re

import pytest

from aislelens.llm.common import attach
from aislelens.llm.exact_dedup import DigestIndex, exact_dedup
from aislelens.session import scratch_path

from . import cases


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_keeps_the_first_row_of_each_text(spark):
    kept = exact_dedup(cases.frame(spark), DigestIndex(spark)).collect()
    best = {}
    for r in cases.rows():
        k = normal(r[1])
        if k not in best or (r[0] is None, r[0] or 0) < (best[k] is None, best[k] or 0):
            best[k] = r[0]
    assert sorted(map(cases.key, [(r.doc_id, normal(r.text)) for r in kept])) == sorted(
        map(cases.key, [(v, k) for k, v in best.items()]))
    assert kept[0].__fields__ == cases.frame(spark).columns


def test_index_persists_and_new_batches_meet_it(spark):
    path = scratch_path(spark, "index")
    docs = cases.frame(spark).filter("doc_id in (1, 8, 9)")
    assert exact_dedup(docs, DigestIndex(spark, path, buckets=4)).count() == 3
    later = exact_dedup(cases.frame(spark), DigestIndex(spark, path, buckets=4))
    assert not {1, 2, 8, 9} & {r.doc_id for r in later.collect()}
    assert exact_dedup(cases.frame(spark), DigestIndex(spark, path, buckets=4)).count() == 0


def test_another_bucket_count(spark):
    """An index is read with the count it was written with, whatever the session says; another one is refused."""
    path = scratch_path(spark, "index")
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string")
    assert exact_dedup(docs, DigestIndex(spark, path, buckets=8)).count() == 200
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("4", "3", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            index = DigestIndex(spark, path)
            assert index.buckets == 8 and exact_dedup(docs, index).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError):
        DigestIndex(spark, path, buckets=4)


def test_a_batch_offered_again(spark, monkeypatch):
    """A job that died after (or in) its append decides the same when it comes again, and appends nothing twice."""
    path = scratch_path(spark, "index")
    docs = cases.frame(spark)
    exact_dedup(docs.filter("doc_id in (8, 9)"), DigestIndex(spark, path, buckets=4), "a").count()
    once = sorted(map(cases.key, ((r.doc_id, r.text) for r in exact_dedup(docs, DigestIndex(spark, path), "b").collect())))
    index = DigestIndex(spark, path)
    held = index.frame.count()
    again = sorted(map(cases.key, ((r.doc_id, r.text) for r in exact_dedup(docs, index, "b").collect())))
    assert once == again and index.frame.count() == held and 8 not in [r[0] for r in once]
    assert exact_dedup(docs, index, "c").count() == 0


def test_merge_and_catalog(spark):
    path = scratch_path(spark, "index")
    with DigestIndex(spark, path, buckets=2) as index:
        for k in range(5):
            exact_dedup(spark.createDataFrame([(k, f"text {k}"), (k, f"more {k}")], "doc_id long, text string"), index).count()
        before = sorted(r.keep_id for r in index.frame.collect())
        assert index.files() > 4 and index.merge(at_least=1) and index.files() <= 2
        assert sorted(r.keep_id for r in index.frame.collect()) == before
        assert exact_dedup(spark.createDataFrame([(9, "text 3"), (10, "new")], "doc_id long, text string"), index).count() == 1
    with DigestIndex(spark, path) as index:
        assert index.generation == 1 and index.frame.count() == 11
    assert not [t.name for t in spark.catalog.listTables() if t.name == index.name]


def test_anti_join_reads_the_index_by_bucket(spark):
    index = DigestIndex(spark, buckets=4)
    exact_dedup(cases.frame(spark), index)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = index.unseen(index.frame.limit(5))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    assert plan.count("hashpartitioning") == 1  # the new side alone


def test_empty(spark):
    assert exact_dedup(cases.empty(spark), DigestIndex(spark)).count() == 0


def test_attach_splits_hot_keys(spark):
    rows = spark.range(4000).selectExpr("id", "if(id % 3 = 0, 0, id) AS k")
    groups = rows.groupBy("k").count()
    out = attach(rows, groups, "k", "count")
    assert out.count() == 4000 and out.filter("k = 0").select("count").distinct().collect()[0][0] == 1334
