"""Exact dedup (operator 8, native): a persistent digest index, bucketed and sorted by hash.

The index is a parquet table bucketed and sorted by the SHA-256 of the normalised text. New documents are
grouped by digest (combined before the shuffle), a sort-merge anti-join against the index finds the digests
not seen before (only the new side is shuffled: the index side is read by bucket), and these are appended.

The bucket count is stored beside the files: an index is always read and written with its own count, whatever the
session's settings, and opening it with another one is an error. A batch may have a name: if it is offered again
(its job died after the append), digests that it brought itself do not count as seen, and none is appended twice.
After MERGE_FILES appended files a bucket the index is rewritten as one file a bucket, in a new generation of the
table; readers of the one before keep it until the next. One writer at a time.

Defined results: null text counts as empty; all empty texts are one group. Of equal texts in a batch the row
with the smallest doc_id stays (null doc_ids last; among rows that repeat the doc_id, exactly one). A digest
already in the index drops the whole group, and ``keep_id`` is the id that the index holds. An empty batch
gives an empty result. Extra columns of any name pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, folder_names, materialise, scratch_path
from .common import WHITE, attach, numbered, table, unpacked

MERGE_FILES = 16
#: Batches in which the query offers the table, by doc_id.
BATCHES = 2


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text in UTF-8, each run of white space replaced by one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "), 256))


class DigestIndex:
    """The digests kept so far, at ``path``; opening an existing path continues it.

    While it is open, the session's catalog has a table for it; ``close`` (or leaving a ``with`` block) drops that
    and leaves the files.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "digest-index")
        stored = self._marks("buckets")
        if stored and buckets and buckets != stored[0]:
            raise ValueError(f"the index at {self.path} has {stored[0]} buckets, not {buckets}")
        self.buckets = stored[0] if stored else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not stored:
            self._mark("buckets", self.buckets)
        self.generation = max(self._marks("generation"), default=0)
        self._open()

    def _marks(self, name: str) -> list[int]:
        """What is stored under a name, as empty files called _<name>=<number>."""
        return [int(x.split("=")[1]) for x in folder_names(self.spark, self.path) if x.startswith(f"_{name}=")]

    def _mark(self, name: str, value: int) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_{name}={value}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True).close()

    def _folder(self, generation: int) -> str:
        return f"{self.path}/generation-{generation}"

    def _create(self, generation: int) -> str:
        name = f"digest_index_{uuid.uuid4().hex[:12]}"
        self.spark.sql(f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) "
                       f"SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self._folder(generation)}'")
        return name

    def _open(self) -> None:
        self.name = self._create(self.generation)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @property
    def frame(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame, batch: str | None = None) -> DataFrame:
        """The groups whose digest the index lacks (or has from this batch alone): a sort-merge anti-join."""
        held = self.frame if batch is None else self.frame.filter(~F.col("batch").eqNullSafe(batch))
        return groups.join(held.select("digest").hint("merge"), "digest", "left_anti")

    def _insert(self, name: str, rows: DataFrame) -> None:
        """One file per bucket: the rows are dealt out by the hash that buckets the table."""
        (rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest")
         .write.mode("append").insertInto(name))
        self.spark.catalog.refreshTable(name)

    def append(self, groups: DataFrame, batch: str | None = None) -> None:
        self._insert(self.name, groups.withColumn("batch", F.lit(batch).cast("string")))

    def files(self) -> int:
        return sum(x.startswith("part-") for x in folder_names(self.spark, self._folder(self.generation)))

    def merge(self, at_least: int = MERGE_FILES) -> bool:
        """Rewrites the index as one file a bucket if it has ``at_least`` files a bucket."""
        if self.files() < at_least * self.buckets:
            return False
        after = self.generation + 1
        delete_path(self.spark, self._folder(after))  # of a merge that died
        name = self._create(after)
        self._insert(name, self.spark.read.schema(self.frame.schema).parquet(self._folder(self.generation)))
        self._mark("generation", after)
        self.close()
        for old in range(self.generation):
            delete_path(self.spark, self._folder(old))
        self.name, self.generation = name, after
        return True

    def add(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """Deduplicate numbered rows (digest, doc_id, rid, ...) and append their new digests.

        Returns the rows with keep_id, group_size (rows of the batch with that digest) and kept.
        """
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
        groups = rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size"))
        groups = materialise(groups.select("digest", F.col("first.doc_id").alias("keep_id"),
                                           F.col("first.rid").alias("keep_rid"), "group_size"), "digest-groups")
        new = materialise(self.unseen(groups, batch), "digest-new")
        old = self.frame.select("digest", F.col("keep_id").alias("held_id"), "batch").hint("merge")
        if batch is not None:
            old = old.filter(~F.col("batch").eqNullSafe(batch))
        held = (groups.join(old, "digest")
                .select("digest", F.col("held_id").alias("keep_id"), F.lit(None).cast(groups.schema["keep_rid"].dataType).alias("keep_rid"),
                        "group_size"))
        held = materialise(held, "digest-held")
        self.append(new if batch is None else materialise(self.unseen(new), "digest-left"), batch)
        decided = new.unionByName(held)
        self.merge()
        return (attach(rows, decided, "digest", "group_size")
                .withColumn("kept", F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(False)))
                .drop("keep_rid"))


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; their digests are appended to ``index``."""
    rows = numbered(docs, "digest-docs")
    light = rows.select("rid", F.col("row.doc_id").alias("doc_id"), digest(F.col("row.text")).alias("digest"))
    stay = index.add(materialise(light, "digest-rows"), batch).filter("kept").select("rid")
    return unpacked(rows.join(stay, "rid", "left_semi"), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document with the row that stays for its text.

    The table is offered to a new index in BATCHES batches of ascending doc_ids, so the texts of later ones meet
    those that the index holds from earlier ones; sizes are those of the groups over all batches.
    """
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    rows = materialise(rows.withColumn("rid", F.monotonically_increasing_id()), "digest-rows")
    cuts = rows.agg(F.percentile_approx("doc_id", [k / BATCHES for k in range(1, BATCHES)])).first()[0] or []
    batch = sum((F.when(F.col("doc_id") <= cut, 0).otherwise(1) for cut in cuts), F.lit(0))
    batch = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(batch)
    with DigestIndex(spark) as index:
        decided = [index.add(rows.filter(batch == k), f"batch {k}").drop("group_size") for k in range(len(cuts) + 1)]
        every = decided[0]
        for part in decided[1:]:
            every = every.unionByName(part)
        every = materialise(every, "digest-decided")
    sizes = materialise(rows.groupBy("digest").agg(F.count("*").alias("group_size")), "digest-sizes")
    return attach(every, sizes, "digest", "group_size").select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


#: The SQL twin. doc_id is unique in the tables, so "the row with the smallest doc_id" needs no tie rule here.
SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
