from pyspark.sql import functions as F

from aislelens.llm.common import _is_scan, numbered, unpacked
from aislelens.session import scratch_path

from . import cases


def test_row_ids_are_unique_whatever_the_frame(spark):
    path = scratch_path(spark, "docs")
    cases.frame(spark).write.parquet(path)
    scan = spark.read.parquet(path)
    twice = scan.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    frames = {"scan": scan, "filter": scan.filter("doc_id > 3").select("doc_id", "text"), "explode": twice,
              "union": scan.unionByName(scan), "join": scan.join(twice.select("doc_id"), "doc_id"), "made": cases.frame(spark),
              "json": spark.createDataFrame([], "doc_id long")}
    assert [n for n, f in frames.items() if _is_scan(f)] == ["scan", "filter"]
    for name, frame in frames.items():
        rows = numbered(frame, "t")
        ids = [r.rid for r in rows.select("rid").collect()]
        assert len(set(ids)) == len(ids) == frame.count(), name
        assert ids == [r.rid for r in rows.select("rid").collect()], name   # a second read gives them again
        assert unpacked(rows, frame).columns == frame.columns
