"""ST1: the customer profile (customer_360) kept up to date by change feeds.

The state holds, by bucket of the customer: customers, orders and CRM events as rows, and per customer the sums
behind the profile: orders of the 90-day window (count, spend in millionths, returns, latest day) and CRM counts.
Nothing in it depends on the run date but the window; ages in days are computed on read.

A refresh takes signed rows (``_sign`` 1: the row came, -1: it went; an update is both, see ``signed_changes``) and
adds their signed sums to the affected customers. The window moves with the latest order: rows that leave it are
signed rows as well, found in the buckets whose oldest day of the window (kept in the manifest) has passed, so
customers change without a row of their own. (Where the latest order is retracted the window moves back, and all
buckets are asked for rows that enter it.) A latest day that went is read again from the customer's own rows. Only
buckets with such customers are read and written; the others' folders are part of the next version as they are. A
version becomes visible through its manifest (``plans.versions``), which also names the ingest commits it has seen.

``refresh_from_drops`` is the whole triggered refresh: new export files -> bronze commits -> signed silver rows of
the keys that changed -> profile. A run that dies leaves the last version; the next one takes up the same commits.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.exact import MONEY_SCALE, micros, money, round_ratio
from ..operators import gold, silver
from ..plans.versions import Versions
from ..session import folder_names, materialise, scratch_scope
from ..sources.ingest import Bronze

BUCKETS = 64

CUSTOMERS = "customer_id long, customer_name string, store_id long, age int, segment string, preferred_channel string, days_since_join int"
ORDERS = "order_id long, customer_id long, order_date date, order_value double, is_returned boolean"
EVENTS = "event_id long, customer_id long, event_type string, event_date date"
FEATURES = "customer_id long, orders long, spend decimal(38,0), returned long, last_order_date date"
CONTACTS = "customer_id long, total_events long, complaints long, return_requests long, last_contact_date date"
SCHEMAS = {"customers": CUSTOMERS, "orders": ORDERS, "events": EVENTS, "features": FEATURES, "contacts": CONTACTS}
DAYS = {"orders": "order_date", "events": "event_date"}
SUMS = {"features": ["orders", "spend", "returned"], "contacts": ["total_events", "complaints", "return_requests"]}
LAST = {"features": "last_order_date", "contacts": "last_contact_date"}


def signed_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that went (``_sign`` -1) and came (1) between two snapshots: one shuffle, rows that stay cancel out."""
    both = before.withColumn("_sign", F.lit(-1)).unionByName(after.withColumn("_sign", F.lit(1)))
    return _netted(both)


def _netted(signed: DataFrame) -> DataFrame:
    """Signed rows after equal ones have cancelled out."""
    columns = [c for c in signed.columns if c != "_sign"]
    net = signed.groupBy(*columns).agg(F.sum("_sign").alias("_sign")).filter("_sign <> 0")
    copies = F.array_repeat(F.signum("_sign").cast("int"), F.abs("_sign").cast("int"))
    return net.select(*columns, F.explode(copies).alias("_sign"))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def names(table: str) -> list[str]:
    """The columns of a table of the state."""
    return _names(SCHEMAS[table])


class ProfileStore:
    """The state below ``root``; ``touched`` names the buckets that the last refresh read, by table."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, lookback_days: int = C.CHURN_LOOKBACK_DAYS):
        self.spark, self.root, self.lookback = spark, root.rstrip("/"), lookback_days
        self.versions = Versions(spark, root)
        latest = self.versions.read()
        self.buckets = latest["buckets"] if latest else buckets  # the count that the files were written with
        self.touched: dict[str, set[int]] = {}

    # -- reading ----------------------------------------------------------------
    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.coalesce("customer_id", F.lit(0))), F.lit(self.buckets)).cast("int")

    def _read(self, state: dict, table: str, only: set[int] | None = None) -> DataFrame:
        """A table's rows as of a version, of all buckets or some."""
        held = {int(b): folder for b, folder in state["tables"][table].items()}
        paths = [os.path.join(self.root, held[b]) for b in sorted(held) if only is None or b in only]
        if only is not None:
            self.touched.setdefault(table, set()).update(set(held) & only)
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*paths)

    def _empty(self) -> dict:
        return {"buckets": self.buckets, "tables": {t: {} for t in SCHEMAS}, "latest": {t: {} for t in DAYS}, "oldest": {},
                "day": dict.fromkeys(DAYS), "commits": {}, "folders": []}

    def applied(self, table: str) -> int:
        """The last ingest commit of a raw table that the profile has seen."""
        return (self.versions.read() or self._empty())["commits"].get(table, 0)

    # -- writing ----------------------------------------------------------------
    def _write(self, state: dict, n: int, table: str, rows: DataFrame, changed: set[int]) -> None:
        """The changed buckets of a table, in version n; a large bucket becomes several files."""
        folder = f"{table}/v={n}"
        rows = rows.select(*_names(SCHEMAS[table]), self._bucket().alias("bucket")).hint("rebalance", "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(os.path.join(self.root, folder))
        there = {int(x.split("=")[1]) for x in _folders(self.spark, os.path.join(self.root, folder))}
        held = {b: f for b, f in state["tables"][table].items() if int(b) not in changed}
        state["tables"][table] = held | {str(b): f"{folder}/bucket={b}" for b in sorted(there)}

    def refresh(self, customers: DataFrame | None = None, orders: DataFrame | None = None, events: DataFrame | None = None,
                commits: dict[str, int] | None = None) -> int:
        """Applies signed rows and publishes a new version; its number."""
        self.touched = {}
        with scratch_scope(self.spark):
            return self._refresh({"customers": customers, "orders": orders, "events": events}, commits or {})

    def _refresh(self, feeds: dict[str, DataFrame | None], commits: dict[str, int]) -> int:
        old = self.versions.read() or self._empty()
        new = old | {"tables": dict(old["tables"]), "latest": dict(old["latest"]), "commits": old["commits"] | commits}
        n = self.versions.next_number()
        signed, changed = {}, {}
        for table, feed in feeds.items():
            feed = self.spark.createDataFrame([], SCHEMAS[table] + ", _sign int") if feed is None else feed
            signed[table] = materialise(feed.select(*_names(SCHEMAS[table]), F.col("_sign").cast("int")), f"{table}-feed")
            changed[table] = self._buckets_of(signed[table])
            if changed[table]:
                rows = self._read(old, table, changed[table]).withColumn("_sign", F.lit(1)).unionByName(signed[table])
                self._write(new, n, table, _netted(rows).filter("_sign > 0"), changed[table])
        for table, column in DAYS.items():
            new["latest"][table] = self._by_bucket(new, table, changed[table], new["latest"][table], F.max(column))
        new["day"] = {t: max((d for d in new["latest"][t].values() if d), default=None) for t in DAYS}
        window, reached = self._window_changes(old, new, signed["orders"])
        since = self._since(new["day"]["orders"])
        new["oldest"] = self._by_bucket(new, "orders", changed["orders"] | reached, old["oldest"],
                                        F.min(F.when(F.col("order_date") >= since, F.col("order_date"))))
        delta = window.groupBy("customer_id").agg(
            F.sum("_sign").alias("orders"), F.sum(F.col("_sign") * micros("order_value")).cast("decimal(38,0)").alias("spend"),
            F.sum(F.col("_sign") * F.coalesce(F.col("is_returned"), F.lit(False)).cast("int")).alias("returned"), *_ends("order_date"))
        self._add(old, new, n, "features", delta, self._rows_in_window)
        said = signed["events"].groupBy("customer_id").agg(
            F.sum("_sign").alias("total_events"),
            F.sum(F.when(F.col("event_type") == C.EVENT_COMPLAINT, F.col("_sign")).otherwise(0)).alias("complaints"),
            F.sum(F.when(F.col("event_type") == C.EVENT_RETURN_REQUEST, F.col("_sign")).otherwise(0)).alias("return_requests"),
            *_ends("event_date"))
        self._add(old, new, n, "contacts", said, self._event_days)
        new["folders"] = sorted({f for held in new["tables"].values() for f in held.values()})
        self.versions.publish(n, new)
        return n

    def _buckets_of(self, rows: DataFrame) -> set[int]:
        return {r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()}  # at most ``buckets`` rows

    def _by_bucket(self, state: dict, table: str, changed: set[int], before: dict, day: Column) -> dict[str, str | None]:
        """A day of each bucket, computed anew for the changed ones."""
        if not changed:
            return before
        found = self._read(state, table, changed).groupBy(self._bucket().alias("b")).agg(day.cast("string").alias("d"))
        return {b: d for b, d in before.items() if int(b) not in changed} | {str(r["b"]): r["d"] for r in found.collect()}

    def _since(self, day: str | None) -> Column:
        """The first day of the window that ends with ``day``."""
        if day is None:
            return F.lit(None).cast("date")
        return F.lit(str(dt.date.fromisoformat(day) - dt.timedelta(days=self.lookback))).cast("date")

    def _window_changes(self, old: dict, new: dict, feed: DataFrame) -> tuple[DataFrame, set[int]]:
        """Signed rows of the window (from the feed, and rows that stay but leave or enter it), and the buckets
        that were read for the latter."""
        was, now = old["day"]["orders"], new["day"]["orders"]
        before, after, day = self._since(was), self._since(now), F.col("order_date")
        out = feed.filter(F.when(F.col("_sign") < 0, day >= before).otherwise(day >= after))
        if was is None or now == was:
            return out, set()
        if now is None:  # no dated order is left: every row is in the feed
            return out, set()
        forward = now > was
        low, high, sign = (before, after, -1) if forward else (after, before, 1)
        edge = str(dt.date.fromisoformat(now) - dt.timedelta(days=self.lookback))
        reached = {int(b) for b in old["tables"]["orders"] if not forward or (old["oldest"].get(b) or edge) < edge}
        strip = (day >= low) & (day < high)
        stay = self._read(old, "orders", reached).filter(strip).withColumn("_sign", F.lit(sign))
        gone = feed.filter(strip & (F.col("_sign") < 0)).withColumn("_sign", F.lit(-sign))  # these don't stay
        return out.unionByName(stay).unionByName(gone), reached

    def _rows_in_window(self, new: dict, only: set[int]) -> DataFrame:
        rows = self._read(new, "orders", only).filter(F.col("order_date") >= self._since(new["day"]["orders"]))
        return rows.select("customer_id", F.col("order_date").alias("day"))

    def _event_days(self, new: dict, only: set[int]) -> DataFrame:
        return self._read(new, "events", only).select("customer_id", F.col("event_date").alias("day"))

    def _add(self, old: dict, new: dict, n: int, table: str, delta: DataFrame, days_of) -> None:
        """Adds signed sums to a table of sums; a latest day that went is looked up among the rows that stay."""
        delta = materialise(delta, f"{table}-delta")
        changed = self._buckets_of(delta)
        if not changed:
            return
        sums, last = SUMS[table], LAST[table]
        o, d = self._read(old, table, changed).alias("o"), delta.alias("d")
        value = [(F.coalesce(F.col(f"o.{c}"), F.lit(0)) + F.coalesce(F.col(f"d.{c}"), F.lit(0))).alias(c) for c in sums]
        joined = (o.join(d, F.col("o.customer_id").eqNullSafe(F.col("d.customer_id")), "full_outer")
                  .select(F.coalesce("o.customer_id", "d.customer_id").alias("customer_id"), *value,
                          F.greatest(f"o.{last}", "d._came").alias(last),
                          F.coalesce(F.col("d._gone") >= F.greatest(f"o.{last}", "d._came"), F.lit(False)).alias("_stale")))
        joined = materialise(joined.filter(F.col(sums[0]) != 0), f"{table}-sums")
        stale = joined.filter("_stale")
        again = self._buckets_of(stale)
        days = days_of(new, again).alias("r").join(
            stale.select("customer_id").alias("s"), F.col("r.customer_id").eqNullSafe(F.col("s.customer_id")), "left_semi")
        days = days.groupBy("customer_id").agg(F.max("day").alias("_day"))
        j = joined.alias("j").join(days.alias("r"), F.col("j.customer_id").eqNullSafe(F.col("r.customer_id")), "left")
        rows = j.select("j.customer_id", *sums, F.when(F.col("_stale"), F.col("_day")).otherwise(F.col(f"j.{last}")).alias(last))
        self._write(new, n, table, rows, changed)

    # -- the profile --------------------------------------------------------------
    def profile(self, stores: DataFrame, version: int | None = None, audit: bool = False) -> DataFrame:
        """customer_360 as of a version (the latest one by default)."""
        state = self.versions.read(version) or self._empty()
        day, contact = (F.lit(state["day"][t]).cast("date") for t in DAYS)
        n = F.col("orders")
        features = self._read(state, "features").select(
            "customer_id", n.alias("order_count_90d"), money(F.col("spend")).alias("total_spend_90d"),
            round_ratio(F.col("spend"), n * MONEY_SCALE, 2).alias("avg_order_value"), "last_order_date",
            F.datediff(day, "last_order_date").alias("recency_days"), round_ratio(F.col("returned"), n, 3).alias("return_rate"))
        contacts = self._read(state, "contacts").withColumn("days_since_last_contact", F.datediff(contact, "last_contact_date"))
        return gold.customer_360(self._read(state, "customers"), stores, features, contacts, audit=audit)


def _ends(day: str) -> list[Column]:
    """The latest day that came, and that went."""
    return [F.max(F.when(F.col("_sign") > 0, F.col(day))).alias("_came"), F.max(F.when(F.col("_sign") < 0, F.col(day))).alias("_gone")]


def _folders(spark: SparkSession, path: str) -> list[str]:
    return [x for x in folder_names(spark, path) if x.startswith("bucket=")]


# ---------------------------------------------------------------- from drops

def silver_feed(bronze: Bronze, since: int, keys: list[str], of_raw) -> DataFrame:
    """Signed silver rows of the keys that changed after an ingest commit: the survivors of their raw rows before
    and now. Raw rows of other keys are filtered out before any shuffle of theirs."""
    keys_changed = bronze.feed(since).select(*keys).distinct()

    def rows(raw: DataFrame) -> DataFrame:
        same = [raw[k].eqNullSafe(keys_changed[k]) for k in keys]
        return of_raw(raw.join(keys_changed, same, "left_semi"))

    return signed_changes(rows(bronze.current(until=since)), rows(bronze.current()))


def _events(raw: DataFrame) -> DataFrame:
    return raw.withColumn("event_date", F.try_to_date("event_date"))


def refresh_from_drops(spark: SparkSession, drops: str, root: str, fmt: str = "csv", buckets: int = BUCKETS) -> ProfileStore:
    """Ingests new export files below ``drops``/<table> and brings the profile up to date with them."""
    store = ProfileStore(spark, os.path.join(root, "profile"), buckets)
    bronze = {t: Bronze(spark, os.path.join(root, t), t, fmt) for t in ("customers_raw", "orders_raw", "crm_events_raw")}
    for table, target in bronze.items():
        target.ingest(os.path.join(drops, table))
    commits = {t: (b.commits() or [0])[-1] for t, b in bronze.items()}
    news = {t for t, n in commits.items() if n > store.applied(t)}
    if news:
        def feed(table, keys, of_raw):
            return silver_feed(bronze[table], store.applied(table), keys, of_raw) if table in news else None

        raw_events = bronze["crm_events_raw"].feed(store.applied("crm_events_raw")) if "crm_events_raw" in news else None
        store.refresh(
            feed("customers_raw", ["customer_id"], silver.silver_customers),
            feed("orders_raw", ["order_id"], silver.silver_orders),
            None if raw_events is None else _events(raw_events), commits)
    return store
