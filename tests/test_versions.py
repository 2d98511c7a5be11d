"""A refresh becomes visible as a whole or not at all."""

import pytest

from aislelens.plans import warehouse as W
from aislelens.plans.versions import Versions
from aislelens.session import folder_names, scratch_path
from tests.conftest import SMOKE


def seen(spark, root, version=None):
    wh = W.open_version(spark, root, version)
    names = sorted(n for n in wh.counts if n != "table_counts")
    return {n: wh.table(n).count() for n in names}, {r["tbl"]: r["rows"] for r in W.serve_platform_stats(wh).selectExpr("`table` AS tbl", "rows").collect()}


def test_a_refresh_killed_between_two_tables_serves_the_old_ones(spark, monkeypatch):
    root = scratch_path(spark, "versions")
    with pytest.raises(FileNotFoundError):
        W.open_version(spark, root)
    W.refresh_atomic(spark, SMOKE, root, model=False)
    first = seen(spark, root)
    assert len(first[1]) == 14 and first[0]["customer_360"] == 150
    held = W.open_version(spark, root).table("customer_360")
    with monkeypatch.context() as m:
        m.setattr(W, "refresh_corpus", lambda wh: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            W.refresh_atomic(spark, SMOKE, root, model=False)
    assert seen(spark, root) == first and Versions(spark, root).numbers() == [1]
    W.refresh_atomic(spark, SMOKE, root, model=False)
    assert seen(spark, root) == first and seen(spark, root, 1) == first
    assert held.count() == 150  # a reader of the older version
    W.refresh_atomic(spark, SMOKE, root, model=False)
    assert Versions(spark, root).numbers() == [2, 3] and held.inputFiles()
    folders = [n for n in folder_names(spark, root) if n.startswith("refresh-")]
    assert len([n for n in folders if n.startswith("refresh-1-")]) == 0


def test_two_writers(spark):
    versions = Versions(spark, scratch_path(spark, "versions"))
    assert versions.read() is None and versions.next_number() == 1
    versions.publish(1, {"folders": ["a"], "text": "Größe"})
    with pytest.raises(FileExistsError):
        versions.publish(1, {"folders": ["b"]})
    assert versions.read() == {"folders": ["a"], "text": "Größe"}
