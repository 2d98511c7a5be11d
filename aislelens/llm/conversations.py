"""Conversation structure repair (operator 12): cost DP, then prefix-doubling path ranking.

A conversation's rows stand by turn (nulls first; rows of one turn by a digest of role and text, so equal rows are
neighbours). The repaired role initials shall match ``(s?(ua)+)?``, which four states recognise: START, after system,
after user, after assistant. An edit keeps, reroles or deletes a row or inserts one before it; a node is (row, state).

Cost DP: each row is a 4 x 4 matrix of least costs between states, and the least cost from each node to the end is
the (min, +) product of the matrices that follow, formed by doubling for all rows of a segment at once.
Path ranking: an arc is optimal if its cost and the least cost behind it add up to the node's. All nodes are ranked
by the least audit (the edits' initials) of 1, 2, 4, ... letters along optimal arcs: the rank for twice the length is
the rank of (own rank, rank where the doubled pointer leads). A node has at most one arc for each letter, as state
and edit decide the next state, so the rank of a prefix decides where it ends. The final ranks select each node's
first arc, and the least path is read through the doubled pointers.

Spark range-sorts light rows (no texts) into segments of some SEGMENT_ROWS rows. A conversation that spans several
segments is cut there: each segment reports its matrix, these are multiplied up from the end (one row a segment), so
every segment knows the costs behind it; then it reports in which state the least path from each state leaves it, and
these chain into the state in which each segment is entered. So no task holds a long conversation. Only the SHA-256
of a repaired text is sequential by nature: one task streams a conversation's lines in order and holds one batch.

Defined results: null role or text is one space; a null conv_id is a conversation of its own; a null turn stands
first and counts for no gap; an empty role has no initial and is illegal anywhere; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .common import attach, table

#: Fixed values of the contract: white space of a row, ends of a sentence, costs.
BLANK = r"[^\x20\x09-\x0D]"
CLOSED = r"[.!?][\x20\x09-\x0D]*\z"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

#: Rows of a segment, and segments at least.
SEGMENT_ROWS = 50_000
LEAST_SEGMENTS = 12

START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
OTHER = len(INITIALS)
#: A row's first fault.
NONE, IS_BLANK, IS_DUPLICATE, IS_TRUNCATED = range(4)
#: The state after an inserted or reroled row, and its role.
NEXT = np.array([USER, USER, ASSISTANT, USER])
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state after a kept row, by state and initial; none if the grammar forbids it.
KEEP = np.full((4, OTHER + 1), -1)
KEEP[START, :2] = SYSTEM, USER
KEEP[SYSTEM, 1] = KEEP[ASSISTANT, 1] = USER
KEEP[USER, 2] = ASSISTANT
FAR = 1 << 40
#: Letters of an audit in ASCII order; 0 ends it.
LETTERS = b"\0DIKR"
ENDED, D, I, K, R = range(5)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) products of stacks of matrices."""
    return np.min([a[..., :, k, None] + b[..., None, k, :] for k in range(4)], axis=0)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The matrix of inserts, and of each (initial, fault): inserts, then the row."""
    inserts = np.full((4, 4), FAR)
    for s in range(4):
        inserts[s, NEXT[NEXT[s]]], inserts[s, NEXT[s]] = 2 * INSERT, INSERT
        inserts[s, s] = 0
    rows = np.full((OTHER + 1, 4, 4, 4), FAR)
    for initial in range(OTHER + 1):
        for fault in range(4):
            arcs = rows[initial, fault]
            for s in range(4):
                arcs[s, s] = DELETE
                if fault in (IS_BLANK, IS_DUPLICATE):
                    continue
                more = TRUNCATED * (fault == IS_TRUNCATED)
                arcs[s, NEXT[s]] = min(arcs[s, NEXT[s]], REROLE + more)
                if KEEP[s, initial] >= 0:
                    arcs[s, KEEP[s, initial]] = min(arcs[s, KEEP[s, initial]], more)
    return inserts, _product(inserts, rows)


INSERTS, ROWS = _tables()
#: Least costs from each state to the end of a conversation.
GOAL = np.minimum(INSERTS[:, START], INSERTS[:, ASSISTANT])


def suffixes(initial: np.ndarray, fault: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each row the matrix from before it to the end of its run; ``left``: rows of the run behind it."""
    out, step = ROWS[initial, fault], 1
    while step <= left.max(initial=0):
        at = np.flatnonzero(left >= step)
        out[at] = _product(out[at], out[at + step])
        step *= 2
    return out


class Paths:
    """The least optimal paths of runs of rows that lie one after the other.

    ``sizes``: rows of each run; ``ends``: least costs from each state behind it, GOAL where it is the last one of
    its conversation (``last``). Row i of run r has place i + r, the place behind the run follows; node = 4 * place + state.
    """

    def __init__(self, initial: np.ndarray, fault: np.ndarray, sizes: np.ndarray, ends: np.ndarray, last: np.ndarray):
        n, runs = len(initial), len(sizes)
        self.run = np.repeat(np.arange(runs), sizes)
        stop = np.cumsum(sizes)
        self.first = (stop - sizes) + np.arange(runs)
        behind = stop + np.arange(runs)
        place = np.arange(n) + self.run
        costs = np.empty((n + runs, 4), np.int64)
        costs[place] = (suffixes(initial, fault, stop[self.run] - 1 - np.arange(n)) + ends[self.run][:, None, :]).min(2)
        costs[behind] = ends
        self.costs, costs = costs, costs.ravel()
        arcs = np.full((len(LETTERS), len(costs)), -1)  # where each letter leads, if that is optimal
        state = np.arange(4)
        own, then = 4 * place[:, None] + state, 4 * place[:, None] + 4
        more = np.where(fault == IS_TRUNCATED, TRUNCATED, 0)[:, None]
        may = ~np.isin(fault, (IS_BLANK, IS_DUPLICATE))[:, None]
        kept = KEEP.T[initial]

        def optimal(letter, node, target, cost, allowed=True):
            there = allowed & (costs[node] == cost + costs[target])
            arcs[letter, node[there]] = target[there]

        optimal(D, own, then + state, DELETE)
        optimal(I, own, own - state + NEXT, INSERT)
        optimal(K, own, then + np.maximum(kept, 0), more, may & (kept >= 0))
        optimal(R, own, then + NEXT, REROLE + more, may)
        tails = 4 * behind[last][:, None] + np.array([SYSTEM, USER])
        optimal(I, tails, 4 * behind[last][:, None] + NEXT[[SYSTEM, USER]], INSERT)
        self.costs_flat = costs
        self._rank(arcs)

    def _rank(self, arcs: np.ndarray) -> None:
        nodes = np.arange(arcs.shape[1])
        letter = np.where((arcs >= 0).any(0), (arcs >= 0).argmax(0), ENDED)
        pointer = np.where(letter == ENDED, nodes, arcs[letter, nodes])
        rank, self.length, doubled = letter.astype(np.int64), (letter != ENDED).astype(np.int64), [pointer]
        while (self.length < self.length[pointer] + self.length).any():
            rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
            self.length = self.length + self.length[pointer]
            pointer = pointer[pointer]
            doubled.append(pointer)
        # The ranks are those of whole audits now; each node takes the arc with the least (letter, rank behind it).
        key = np.where(arcs >= 0, np.arange(len(arcs))[:, None] * (rank.max(initial=0) + 1) + rank[arcs], np.iinfo(np.int64).max)
        self.letter = np.where(letter == ENDED, ENDED, key.argmin(0))
        self.doubled = [np.where(letter == ENDED, nodes, arcs[self.letter, nodes]), *doubled[1:]]

    def exits(self, run: int) -> list[int]:
        """The state in which the least path from each state leaves a run."""
        return (self.doubled[-1][4 * self.first[run] + np.arange(4)] % 4).tolist()

    def read(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(run, letter, row or -1, state after it) of each step of each run's least path, and the runs' costs."""
        start = 4 * self.first + entries
        sizes = self.length[start]
        run = np.repeat(np.arange(len(start)), sizes)
        step = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        node = start[run]
        for k, pointer in enumerate(self.doubled):
            there = (step >> k) & 1 == 1
            node[there] = pointer[node[there]]
        letter, target = self.letter[node], self.doubled[0][node]
        row = np.where((letter == K) | (letter == R), node // 4 - run, -1)
        cost = np.bincount(run, self.costs_flat[node] - self.costs_flat[target], len(start)).astype(np.int64)
        return run, letter, row, target % 4, cost


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the contract: a twentieth of the rows each is dropped, emptied, loses its
    sentence ends, is repeated, or becomes the user's; chosen by the CRC-32 of ``conv_id:turn``."""
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                       *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    ids = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    hit = F.crc32(F.concat(ids[0], F.lit(":"), ids[1])) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (rows.filter(hit != 0)
            .select("conv_id", "turn", F.when(hit == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(copies).alias("copy")).drop("copy"))


def _faults(turns: DataFrame) -> DataFrame:
    """(rid, conv_id, turn, key, initial, fault) of materialised rows."""
    said = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.length("role").cast("string"),
                    F.lit(":"), "role", "text")
    light = materialise(turns.select(
        "rid", "conv_id", "turn", F.unhex(F.sha2(said, 256)).alias("key"), F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(BLANK)).alias("blank"), (~F.col("text").rlike(CLOSED)).alias("open")), "conversation-rows")
    first = F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn", "rid"))
    groups = materialise(light.groupBy("key").agg(first.alias("first"), F.count("*").alias("n")), "conversation-texts")
    fault = (F.when(F.col("blank"), IS_BLANK).when(F.col("rid") != F.col("first.rid"), IS_DUPLICATE)
             .when(F.col("open"), IS_TRUNCATED).otherwise(NONE))
    return attach(light, groups, "key", "n").select("rid", "conv_id", "turn", "key", "initial", fault.alias("fault"))


NOTES = "seg int, conv_id long, ends array<long>, entry int, before string, before_turn long, follows boolean"


class _Runs:
    """The rows of a segment, cut into one run for each conversation, and what is noted about the first and last one."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches)
        notes = rows.filter(pa.compute.equal(rows["kind"], 0)).to_pylist()
        rows = rows.filter(pa.compute.equal(rows["kind"], 1))
        self.seg = batches[0].column("seg")[0].as_py()
        self.rid, self.fault = rows["rid"].to_numpy(), rows["fault"].to_numpy()
        self.shown = np.array(rows["initial"].to_pylist(), object)
        self.initial = np.array([INITIALS.find(x) if x else -1 for x in self.shown], np.int64)
        self.initial[self.initial < 0] = OTHER
        self.conv, self.no_conv = self._longs(rows["conv_id"])
        self.turn, self.no_turn = self._longs(rows["turn"])
        new = np.ones(len(rows), bool)
        new[1:] = (self.conv[1:] != self.conv[:-1]) | (self.no_conv[1:] != self.no_conv[:-1])
        self.start = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.start, len(rows)))
        self.noted = {}
        for note in notes:
            run = next(r for r in {0, len(self.start) - 1} if self.conv_id(r) == note["conv_id"])
            self.noted[run] = note

    @staticmethod
    def _longs(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        return column.fill_null(0).to_numpy(), column.is_null().to_numpy()

    def conv_id(self, run: int) -> int | None:
        at = self.start[run]
        return None if self.no_conv[at] else int(self.conv[at])

    def paths(self) -> Paths:
        ends = np.repeat(GOAL[None], len(self.start), 0)
        last = np.ones(len(self.start), bool)
        for run, note in self.noted.items():
            if note["ends"] is not None:
                ends[run], last[run] = note["ends"], False
        return Paths(self.initial, self.fault, self.sizes, ends, last)


def _edges(runs: _Runs) -> list[tuple]:
    """(conv_id, seg, matrix, last initial, last turn) of the first and the last run."""
    out = []
    for run in sorted({0, len(runs.start) - 1}):
        at = slice(runs.start[run], runs.start[run] + runs.sizes[run])
        left = np.arange(runs.sizes[run])[::-1]
        matrix = suffixes(runs.initial[at], runs.fault[at], left)[0]
        end = at.stop - 1
        out.append((runs.conv_id(run), runs.seg, matrix.ravel().tolist(), runs.shown[end],
                    None if runs.no_turn[end] else int(runs.turn[end])))
    return out


def _exits(runs: _Runs) -> list[tuple]:
    """(conv_id, seg, exits) of the runs that are part of a longer conversation."""
    paths = runs.paths()
    return [(runs.conv_id(run), runs.seg, paths.exits(run)) for run in runs.noted]


def _pieces(runs: _Runs) -> list[tuple]:
    """What each run adds to its conversation's result, and its repaired rows: (rid, new role)."""
    entries = np.zeros(len(runs.start), np.int64)
    n = len(runs.rid)
    head = np.zeros(n, bool)
    head[runs.start] = True
    before, before_turn, no_before_turn = np.roll(runs.shown, 1), np.roll(runs.turn, 1), np.roll(runs.no_turn, 1)
    follows = ~head
    for run, note in runs.noted.items():
        entries[run] = note["entry"] or START
        if note["follows"]:
            at = runs.start[run]
            follows[at], before[at] = True, note["before"]
            no_before_turn[at], before_turn[at] = note["before_turn"] is None, note["before_turn"] or 0
    legal = np.array([(a or "") + (b or "") in ("su", "ua", "au") for a, b in zip(before, runs.shown, strict=True)], bool)
    new_turn = ~runs.no_turn & (~follows | no_before_turn | (before_turn != runs.turn))
    sums = {k: np.add.reduceat(v.astype(np.int64), runs.start) for k, v in (
        ("blank", runs.fault == IS_BLANK), ("duplicate", runs.fault == IS_DUPLICATE),
        ("truncated", runs.fault == IS_TRUNCATED), ("illegal", follows & ~legal), ("turns", new_turn))}
    run, letter, row, state, cost = runs.paths().read(entries)
    audit = np.frombuffer(LETTERS, np.uint8)[letter].tobytes().decode()
    bounds = np.searchsorted(run, np.arange(len(runs.start) + 1))
    out = []
    for r, start in enumerate(runs.start):
        a, b, stop = bounds[r], bounds[r + 1], start + runs.sizes[r]
        lines = [{"rid": int(runs.rid[i]) if i >= 0 else None, "role": None if k == K else ROLES[s]}
                 for k, i, s in zip(letter[a:b].tolist(), row[a:b].tolist(), state[a:b].tolist(), strict=True) if k != D]
        some = runs.turn[start:stop][~runs.no_turn[start:stop]]
        out.append((runs.conv_id(r), runs.seg, audit[a:b], *(int(sums[k][r]) for k in sums), int(cost[r]),
                    int(some[0]) if len(some) else None, int(some[-1]) if len(some) else None, lines))
    return out


PIECES = ("conv_id long, seg int, audit string, blank long, duplicate long, truncated long, illegal long, turns long, cost long, "
          "least long, most long, lines array<struct<rid: long, role: string>>")


def _by_segment(rows: DataFrame, notes: DataFrame | None, segments: int, work, schema: str) -> DataFrame:
    """Rows of ``work(_Runs)`` for each segment."""
    spark = rows.sparkSession
    notes = spark.createDataFrame([], NOTES) if notes is None else notes
    both = (rows.withColumn("kind", F.lit(1)).unionByName(notes.withColumn("kind", F.lit(0)), allowMissingColumns=True)
            .repartitionById(segments, "seg").sortWithinPartitions("kind", "place"))
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    kinds = _arrow(spark, schema)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # a segment: some SEGMENT_ROWS light rows
        if not held:
            return
        found = work(_Runs(held))
        for k in range(0, len(found), 10_000):
            columns = list(zip(*found[k:k + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return both.mapInArrow(segment, schema)


def _arrow(spark: SparkSession, schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(spark.createDataFrame([], schema).schema).types)


def _notes(edges: DataFrame) -> DataFrame:
    """Of conversations over several segments: the costs behind each segment, and the row before it."""

    def up(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("seg", ignore_index=True)
        ends, behind = [None] * len(parts), GOAL
        for k in range(len(parts) - 1, 0, -1):
            behind = (np.array(parts.m[k]).reshape(4, 4) + behind[None, :]).min(1)
            ends[k - 1] = behind.tolist()
        return pd.DataFrame({
            "seg": parts.seg, "conv_id": parts.conv_id, "ends": ends, "entry": None,
            "before": parts["last"].shift(1), "before_turn": parts.turn.astype("Int64").shift(1),
            "follows": np.arange(len(parts)) > 0}).iloc[:len(parts) if len(parts) > 1 else 0]

    return edges.groupBy("conv_id").applyInPandas(up, NOTES)


def _entries(exits: DataFrame) -> DataFrame:
    """(conv_id, seg, entry): the state in which the least path enters each segment."""

    def along(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("seg", ignore_index=True)
        entries, state = [], START
        for k in range(len(parts)):
            entries.append(state)
            state = parts.exits[k][state]
        return pd.DataFrame({"conv_id": parts.conv_id, "seg": parts.seg, "entry": entries})

    return exits.groupBy("conv_id").applyInPandas(along, "conv_id long, seg int, entry int")


def _same(a: DataFrame, b: DataFrame, *names: str):
    out = F.lit(True)
    for n in names:
        out &= a[n].eqNullSafe(b[n])
    return out


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired rows (conv_id, seg, place, role, text; ordered by seg and place) and a report for each
    conversation of ``rows`` (conv_id, turn, role, text): conv_id, gaps, the faults' counts, illegal, cost, audit."""
    turns = materialise(rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
        F.monotonically_increasing_id().alias("rid")), "conversation-turns")
    order = ["conv_id", "turn", "key", "rid"]
    wanted = max(LEAST_SEGMENTS, -(-turns.count() // SEGMENT_ROWS))
    light = (_faults(turns).repartitionByRange(wanted, *order).sortWithinPartitions(*order).drop("key")
             .withColumn("seg", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))
    light = materialise(light, "conversation-segments")
    segments = (light.agg(F.max("seg")).first()[0] or 0) + 1
    edges = _by_segment(light, None, segments, _edges, "conv_id long, seg int, m array<long>, last string, turn long")
    notes = materialise(_notes(materialise(edges, "conversation-edges")), "conversation-notes")
    cut = light.join(notes.select("conv_id", "seg"), _same(light, notes, "conv_id", "seg"), "left_semi")
    exits = materialise(_by_segment(cut, notes, segments, _exits, "conv_id long, seg int, exits array<int>"), "conversation-exits")
    entries = materialise(_entries(exits), "conversation-entries")
    notes = notes.drop("entry").join(entries, _same(notes, entries, "conv_id", "seg")).drop(entries["conv_id"], entries["seg"])
    pieces = materialise(_by_segment(light, notes, segments, _pieces, PIECES), "conversation-pieces")
    parts = F.sort_array(F.collect_list(F.struct("seg", "audit")))  # a letter a row: part of the result
    report = pieces.groupBy("conv_id").agg(
        F.coalesce(F.max("most") - F.min("least") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.array_join(parts.getField("audit"), "").alias("audit"))
    lines = pieces.select("conv_id", "seg", F.posexplode("lines").alias("place", "line"))
    lines = lines.select("conv_id", "seg", "place", "line.rid", F.col("line.role").alias("new"))
    old = (lines.filter("rid IS NOT NULL").join(turns.select("rid", "role", "text"), "rid")
           .select("conv_id", "seg", "place", F.coalesce("new", "role").alias("role"), "text"))
    new = lines.filter("rid IS NULL").select("conv_id", "seg", "place", F.col("new").alias("role"), F.lit("").alias("text"))
    return old.unionByName(new), report


def line_digests(lines: DataFrame) -> DataFrame:
    """(conv_id, sha256): of each conversation's ``role:text`` lines in order, joined by newlines."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, done = None, None, []

        def out():
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1])], ["conv_id", "sha256"])

        for batch in batches:
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line"), strict=True):
                if sha is None or conv != now:
                    if sha is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(line.as_buffer())
            if done:
                yield out()
        if sha is not None:
            done.append((now, sha.hexdigest()))
            yield out()

    line = F.encode(F.concat("role", F.lit(":"), "text"), "UTF-8")
    return (lines.select("conv_id", "seg", "place", line.alias("line")).repartition("conv_id")
            .sortWithinPartitions("conv_id", "seg", "place").select("conv_id", "line")
            .mapInArrow(digests, "conv_id long, sha256 string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the report of every conversation after the contract's damage, with the repaired text's digest."""
    rows = table(spark, sf_dir, "conversations")
    lines, report = repair(damage(rows))
    every = rows.select(F.col("conv_id").cast("long")).distinct()
    report, shas = materialise(report, "conversation-reports"), materialise(line_digests(lines), "conversation-digests")
    out = (every.join(report, _same(every, report, "conv_id"), "left")
           .join(shas, _same(every, shas, "conv_id"), "left"))
    zero = [F.coalesce(report[c], F.lit(0)).cast("long").alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(every["conv_id"], *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
