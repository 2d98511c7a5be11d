"""Per-customer text corpus (Q32/G1) and the change feed between two
corpus snapshots (S11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.exact import floor_div

# CRM notes are concatenated in blocks of this many consecutive event ids
# before the per-customer merge, so a customer with very many events never
# ships them one by one to a single task.
NOTE_BLOCK = 4096
# A customer with more events than this gets several documents.
NOTE_CHUNK = 4096


def customer_notes(events: DataFrame, sep: str = C.NOTES_SEP, block_rows: int = NOTE_BLOCK,
                   chunk_rows: int = NOTE_CHUNK) -> DataFrame:
    """(customer_id, chunk_no) -> CRM notes in (event_date, event_id) order.

    Notes are first joined per (customer, day, event-id block), a group of at
    most NOTE_BLOCK rows. A customer's blocks in order are then cut into
    chunks: a new one begins with the block before which another
    ``chunk_rows`` events are complete, so a chunk holds less than
    ``chunk_rows + block_rows`` events however many a customer has. The chunk
    numbers come from the blocks' counts alone; the texts never meet in one
    task per customer.
    NULL notes are skipped; a chunk whose notes are all NULL gets "".
    """
    keys = ["customer_id", "event_date", "_blk"]
    blocked = events.withColumn("_blk", floor_div(F.col("event_id"), block_rows))
    before = (Window.partitionBy("customer_id").orderBy("event_date", "_blk")
              .rowsBetween(Window.unboundedPreceding, -1))
    numbers = (blocked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("chunk_no", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / chunk_rows)))
    kept = F.collect_list(F.when(F.col("notes").isNotNull(), F.struct("event_id", "notes")))
    partial = (blocked.groupBy(*keys).agg(kept.alias("_items"))
               .select(*keys, F.when(F.size("_items") > 0, F.array_join(
                   F.transform(F.array_sort("_items"), lambda s: s["notes"]), sep)).alias("_part")))
    n, p = numbers.alias("n"), partial.alias("p")
    joined = p.join(n, [F.col(f"p.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]).select("p.*", "n.chunk_no")
    return (joined.groupBy("customer_id", "chunk_no")
            .agg(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("event_date", "_blk", "_part"))),
                lambda s: s["_part"]), sep).alias("all_notes")))


def _seg(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)


def rag_documents(c360: DataFrame, events: DataFrame) -> DataFrame:
    """Q32: one labelled text per customer and chunk of notes (almost always
    one), segments joined by " | ". Later chunks have the id "<customer>-<no>".

    A NULL piece drops its whole segment (customers without CRM events have
    no "CRM notes" segment). Spend is printed with two decimals.
    """
    notes = customer_notes(events)
    c = c360.alias("c").join(notes.alias("n"), "customer_id", "left")
    document = F.concat_ws(
        C.DOC_SEP,
        *[_seg(label, value) for label, value in zip(C.DOC_LABELS, [
            F.col("customer_name"), F.col("segment"), F.col("region"),
            F.col("order_count_90d").cast("string"),
            F.col("total_spend_90d").cast("decimal(18,2)").cast("string"),
            F.col("recency_days").cast("string"),
            F.when(F.col("is_churned") == 1, C.DOC_RISK_TEXT[1]).otherwise(C.DOC_RISK_TEXT[0]),
            F.col("all_notes")])])
    doc_id = F.concat_ws("-", F.col("customer_id").cast("string"), F.when(F.col("chunk_no") > 0, F.col("chunk_no").cast("string")))
    return c.select(doc_id.alias("doc_id"), document.alias("document"),
                    "customer_id", "customer_name", "segment", "region")


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows inserted, updated or deleted between two snapshots.

    A full outer join on ``key`` (both sides shuffle once on it) and a
    null-safe comparison of ``columns``; unchanged keys drop. Deleted rows
    carry their old values, the others their new ones.
    """
    o = old.select(key, F.struct(*columns).alias("_old"))
    n = new.select(key, F.struct(*columns).alias("_new"))
    j = o.join(n, key, "full_outer")
    kind = (F.when(F.col("_old").isNull(), "insert")
            .when(F.col("_new").isNull(), "delete")
            .when(~F.col("_old").eqNullSafe(F.col("_new")), "update"))
    cur = F.coalesce(F.col("_new"), F.col("_old"))
    return (j.withColumn("_change_type", kind).filter(F.col("_change_type").isNotNull())
            .select(key, "_change_type", *[cur[c].alias(c) for c in columns]))


def apply_changes(old: DataFrame, feed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Consume an S11 change feed: the snapshot ``old`` brought up to date.
    Changed keys leave ``old`` (anti join); inserted and updated rows come
    from the feed."""
    kept = old.select(key, *columns).join(feed.select(key), key, "left_anti")
    return kept.unionByName(feed.filter(F.col("_change_type") != "delete").select(key, *columns))
