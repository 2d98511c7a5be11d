"""ST1, U2: triggered (availableNow) incremental refreshes.

New files are picked up by a file stream over the table path (a file or a
directory of part files) and mapped with the same bronze logic as the batch
path. Each micro-batch writes only what it changed to its own ``epoch=<n>``
folder, so a retried batch overwrites only itself, nothing depends on how
late a row arrives, and a trigger without new files leaves everything as it
is. Readers take the rows of the latest state per key; after a refresh with
many epochs they are compacted into one ``base=<n>`` folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators.dedup import keep_first
from ..operators.quality import expect
from ..operators.silver import order_survivor, typed_orders
from ..session import delete_path, folder_names, is_file, scratch_path
from ..sources.adapter import crm_from_events, orders_view

COMPACT_EPOCHS = 20


class Epochs:
    """Rows by epoch in ``folder``; ``keys`` and ``order`` say which row of a key is current.

    ``order`` may use the column ``epoch``.
    """

    def __init__(self, spark: SparkSession, folder: str, schema, keys: list[str], order: list[Column]):
        self.spark, self.folder, self.schema, self.keys, self.order = spark, folder, schema, keys, order

    def write(self, rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(os.path.join(self.folder, f"epoch={epoch}"))

    def _complete(self, kind: str) -> list[int]:
        found = [int(n.split("=")[1]) for n in folder_names(self.spark, self.folder) if n.startswith(f"{kind}=")]
        return sorted(n for n in found if "_SUCCESS" in folder_names(self.spark, os.path.join(self.folder, f"{kind}={n}")))

    def _state(self) -> tuple[list[int], list[int]]:
        bases = self._complete("base")
        return bases, [n for n in self._complete("epoch") if not bases or n > bases[-1]]

    def current(self) -> DataFrame:
        """The current row of each key."""
        bases, epochs = self._state()
        parts = [("base", n) for n in bases[-1:]] + [("epoch", n) for n in epochs]
        rows = self.spark.createDataFrame([], self.schema).withColumn("epoch", F.lit(0).cast("long"))
        for kind, n in parts:
            part = self.spark.read.schema(self.schema).parquet(os.path.join(self.folder, f"{kind}={n}"))
            rows = rows.unionByName(part.withColumn("epoch", F.lit(n).cast("long")))
        return keep_first(rows, self.keys, self.order).drop("epoch")

    def compact(self, at_least: int = COMPACT_EPOCHS) -> None:
        """One new base of all epochs; the base before stays for running readers, older folders go."""
        bases, epochs = self._state()
        if len(epochs) < at_least:
            return
        self.current().write.mode("overwrite").parquet(os.path.join(self.folder, f"base={epochs[-1]}"))
        for n in bases[:-1]:
            delete_path(self.spark, os.path.join(self.folder, f"base={n}"))
        for n in self._complete("epoch"):
            if bases and n <= bases[-1]:
                delete_path(self.spark, os.path.join(self.folder, f"epoch={n}"))


def _read_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None) -> DataFrame:
    """The files of a table that is a file or a folder of part files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if is_file(spark, path):  # a stream's path is a folder
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def summary_aggregate(events: DataFrame) -> DataFrame:
    """Per-customer counts and last contact over CRM events (batch or
    stream)."""
    return (events.groupBy("customer_id")
            .agg(F.count(F.lit(1)).alias("total_events"),
                 F.count_if(F.col("event_type") == C.EVENT_COMPLAINT).alias("complaints"),
                 F.count_if(F.col("event_type") == C.EVENT_RETURN_REQUEST).alias("return_requests"),
                 F.max("event_date").alias("last_contact_date")))


def refresh_crm_summary(spark: SparkSession, events_path: str, out_dir: str | None = None,
                        checkpoint: str | None = None, max_files_per_trigger: int | None = None,
                        as_of=None) -> DataFrame:
    """Run the triggered refresh over the event files at ``events_path`` to
    completion and return the summary as it stands.

    The counts are a streaming aggregation whose state lives under the
    checkpoint; each batch emits the changed customers only (update mode).
    ``days_since_last_contact`` is computed on read against ``as_of``
    (default: the latest contact in the summary, i.e. the latest event).
    """
    out_dir = out_dir or scratch_path(spark, "crm-summary-stream")
    checkpoint = checkpoint or scratch_path(spark, "crm-summary-checkpoint")
    summary = summary_aggregate(crm_from_events(_read_stream(spark, events_path, max_files_per_trigger)))
    store = Epochs(spark, out_dir, summary.schema, ["customer_id"], [F.col("epoch").desc()])
    q = (summary.writeStream.outputMode("update").foreachBatch(store.write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    store.compact()
    snap = store.current()
    day = snap.agg(F.max("last_contact_date")).scalar() if as_of is None else F.lit(str(as_of)).cast("date")
    return snap.withColumn("days_since_last_contact", F.datediff(day, F.col("last_contact_date")))


EXPECTED = "epoch long, dataset string, rule string, rows long, failed long"


def write_expectations(spark: SparkSession, folder: str, epoch: int, dataset: str, counts: dict) -> None:
    """D1 on a stream: the counts that were observed while an epoch was written, in that epoch's folder."""
    rows = [(epoch, dataset, rule, int(counts["rows"]), int(counts[rule])) for rule in C.EXPECTATIONS[dataset]]
    (spark.createDataFrame(rows, EXPECTED).drop("epoch").coalesce(1)
     .write.mode("overwrite").parquet(os.path.join(folder, f"epoch={epoch}")))


def expectations_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset, rule, rows, failed) summed over the epochs that were written whole."""
    names = [n for n in folder_names(spark, folder) if n.startswith("epoch=")
             and "_SUCCESS" in folder_names(spark, os.path.join(folder, n))]
    schema = EXPECTED.removeprefix("epoch long, ")
    rows = (spark.read.schema(schema).parquet(*[os.path.join(folder, n) for n in names]) if names
            else spark.createDataFrame([], schema))
    return rows.groupBy("dataset", "rule").agg(F.sum("rows").alias("rows"), F.sum("failed").alias("failed"))


def refresh_silver_orders(spark: SparkSession, orders_path: str, customers: DataFrame, out_dir: str | None = None,
                          checkpoint: str | None = None, max_files_per_trigger: int | None = None,
                          expectations: str | None = None) -> DataFrame:
    """U2 (streaming form): silver orders kept up to date from newly arrived
    raw orders. Each batch writes the survivors among its own rows; the
    survivor of an order over all batches is chosen by the same total order
    as in the batch path, so the result does not depend on arrival order and
    no order is too late."""
    out_dir = out_dir or scratch_path(spark, "orders-stream")
    checkpoint = checkpoint or scratch_path(spark, "orders-checkpoint")
    typed = typed_orders(orders_view(_read_stream(spark, orders_path, max_files_per_trigger), customers))
    store = Epochs(spark, out_dir, typed.schema, ["order_id"], order_survivor())

    def survivors(batch: DataFrame, epoch: int) -> None:
        batch, seen = expect(batch, C.EXPECTATIONS["orders"], f"orders-{epoch}-{uuid.uuid4().hex[:8]}")
        store.write(keep_first(batch, ["order_id"], order_survivor()), epoch)
        if expectations:
            write_expectations(spark, expectations, epoch, "orders", seen.get)

    q = (typed.writeStream.foreachBatch(survivors).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    store.compact()
    return store.current()


def stream_answers(spark: SparkSession, questions_dir: str, out_dir: str, checkpoint: str,
                   texts: dict, pattern: str = "*.parquet",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """G6-G8 served as a triggered stream: question files dropped into
    ``questions_dir`` (question_id, question) are routed and grounded per
    micro-batch against the current gold tables (``texts`` from
    ``assistant.context_texts``). Each epoch writes its own folder, so a
    retried epoch overwrites only itself. Returns all answers so far."""
    from ..operators import assistant

    schema = spark.read.option("pathGlobFilter", pattern).parquet(questions_dir).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def answer(batch: DataFrame, epoch_id: int) -> None:
        (assistant.ground(batch, texts)
         .write.mode("overwrite").parquet(os.path.join(out_dir, f"epoch={epoch_id}")))

    q = (reader.parquet(questions_dir).writeStream.foreachBatch(answer)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_dir).drop("epoch")
