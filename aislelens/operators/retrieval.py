"""Embedding, exact top-k similarity search, context assembly and prompts
(G2-G5)."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C

EMBED_DIM = 512
QUERY_BLOCK_BYTES = 32 << 20   # query vectors that a task holds; no more are ever broadcast
CORPUS_PART_ROWS = 1 << 20     # corpus rows that a task streams
TASKS_PER_CORE = 2             # at least
BLOCK_BYTES = 8 << 20          # packed corpus rows of a block
BLOCK_ROWS = 1 << 16           # sparse corpus rows that a task takes at once
FIRST_ROWS = 1 << 13           # of them before any other, to know scores that the others must reach
STACK_ROWS = 2048              # rows that are made dense at once
TILE_CELLS = 1 << 22           # scores that a task forms at once (32 MB)
LOOSE_ROWS = 1 << 19           # rows beyond the best that a task gathers before it drops them
MEETING_COST = 32              # of a pair of values that meet, in multiplications of dense vectors
SLACK = 1e-9                   # of a cosine, far more than rounding takes from it


def embed(docs: DataFrame, text_col: str, dim: int = EMBED_DIM):
    """An offline text embedding - word tokens, hashed term counts,
    IDF weights, L2 norm - fitted on ``docs``. Returns the fitted
    PipelineModel; ``vectors(model, df, text_col)`` applies it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    stages = [RegexTokenizer(inputCol="_text", outputCol="_tok", pattern="\\W+", toLowercase=True),
              HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim),
              IDF(inputCol="_tf", outputCol="_tfidf"),
              Normalizer(inputCol="_tfidf", outputCol="_vec", p=2.0)]
    return Pipeline(stages=stages).fit(docs.select(F.col(text_col).alias("_text")))


def vectors(model, df: DataFrame, text_col: str, out: str = "vector") -> DataFrame:
    """Apply an ``embed`` model: adds ``out`` as array<float>."""
    from pyspark.ml.functions import vector_to_array

    return (model.transform(df.withColumn("_text", F.col(text_col)))
            .withColumn(out, vector_to_array("_vec", "float32"))
            .drop("_text", "_tok", "_tf", "_tfidf", "_vec"))


def sync_vectors(model, vectors_before: DataFrame, changes: DataFrame, key: str = "doc_id",
                 text_col: str = "document") -> DataFrame:
    """G2 (sync): apply an S11 change feed to a vector table.

    Deleted and updated keys leave (anti join on ``key``); inserted and
    updated rows are embedded again with the same fitted ``model``. Only
    the changed documents pass through the embedding.
    """
    changed = changes.select(key).distinct()
    kept = vectors_before.join(changed, key, "left_anti")
    fresh = vectors(model, changes.filter(F.col("_change_type") != "delete").select(key, text_col),
                    text_col).select(key, "vector")
    return kept.select(key, "vector").unionByName(fresh)


class _Sparse:
    """Vectors by their values other than 0: how many each vector has, in which columns they stand, and what they are."""

    def __init__(self, counts: np.ndarray, at: np.ndarray, values: np.ndarray, dim: int):
        self.counts, self.at, self.values, self.dim = counts, at, values, dim

    @classmethod
    def of(cls, m: np.ndarray) -> _Sparse:
        row, at = np.nonzero(m)
        return cls(np.bincount(row, minlength=len(m)), at, m[row, at], m.shape[1])

    @classmethod
    def joined(cls, parts: list[_Sparse]) -> _Sparse:
        return cls(*(np.concatenate([getattr(p, x) for p in parts]) for x in ("counts", "at", "values")), parts[0].dim)

    def __len__(self) -> int:
        return len(self.counts)

    def dense(self) -> np.ndarray:
        m = np.zeros((len(self), self.dim), dtype=self.values.dtype)
        m[np.repeat(np.arange(len(self)), self.counts), self.at] = self.values
        return m

    def take(self, order: np.ndarray) -> _Sparse:
        counts = self.counts[order]
        first = (np.cumsum(self.counts) - self.counts)[order]
        entry = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return _Sparse(counts, self.at[entry], self.values[entry], self.dim)


class _Best:
    """The exact k best corpus rows of each query held by a task, over any number of batches.

    Scores of dense vectors are formed in tiles of at most TILE_CELLS, those of sparse ones query by query, over the
    entries of the columns that the query has. Either way a tile or a block leaves k rows a query (ties to the smaller
    ids), so what a task holds depends on neither the batch nor on how many rows tie.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, q_id: str, c_id: str):
        self.ids, self.q, self.k, self.q_id, self.c_id = ids, q, k, q_id, c_id
        self.norms = np.linalg.norm(q, axis=1)
        self.least = np.full(len(q), -np.inf)  # at least k rows of a query score as much or more
        self.found: list[pd.DataFrame] = []
        self.loose = 0

    def add(self, c_ids: np.ndarray, vectors) -> None:
        """Vectors as a series of arrays, the rows of a matrix or a _Sparse."""
        order = pd.Series(c_ids).sort_values(kind="stable").index.to_numpy()  # then the first columns of a tie stay
        c_ids = c_ids[order]
        if isinstance(vectors, _Sparse):
            self._add_sparse(c_ids, vectors.take(order))
            return
        vectors, sparse = vectors.to_numpy() if isinstance(vectors, pd.Series) else vectors, []
        width = max(1, TILE_CELLS // len(self.q))
        for at in range(0, len(order), STACK_ROWS):
            c = np.stack([np.asarray(v, dtype=np.float64) for v in vectors[order[at:at + STACK_ROWS]]])
            if self._is_sparse(np.count_nonzero(c, axis=0), len(c)):
                sparse.append((c_ids[at:at + STACK_ROWS], _Sparse.of(c)))
                continue
            for x in range(0, len(c), width):
                i, j, score = self._tile(c[x:x + width])
                self._keep(i, c_ids[at + x + j], score)
        if sparse:
            self._add_sparse(np.concatenate([i for i, _ in sparse]), _Sparse.joined([s for _, s in sparse]))

    def _is_sparse(self, counts: np.ndarray, n: int) -> bool:
        """Whether few enough values meet: ``counts`` of them in the columns of ``n`` rows."""
        return int(self._counts @ counts) * MEETING_COST <= len(self.q) * n * self.q.shape[1]

    @cached_property
    def _counts(self) -> np.ndarray:
        return np.count_nonzero(self.q, axis=0).astype(np.int64)

    def _keep(self, i: np.ndarray, c_ids: np.ndarray, score: np.ndarray) -> None:
        self.found.append(pd.DataFrame({"_q": i, self.c_id: c_ids, "score": score}))
        self.loose += len(i)
        if self.loose > LOOSE_ROWS + 2 * self.k * len(self.q):
            self._merge()

    def _add_sparse(self, c_ids: np.ndarray, c: _Sparse) -> None:
        """``c`` in the order of its ids."""
        if not self._is_sparse(np.bincount(c.at, minlength=c.dim), len(c)):
            for at in range(0, len(c), STACK_ROWS):
                part = np.arange(at, min(at + STACK_ROWS, len(c)))
                m, width = c.take(part).dense().astype(np.float64), max(1, TILE_CELLS // len(self.q))
                for x in range(0, len(m), width):
                    i, j, score = self._tile(m[x:x + width])
                    self._keep(i, c_ids[at + x + j], score)
            return
        if not self.found and len(c) > 2 * FIRST_ROWS:
            for part in (np.arange(FIRST_ROWS), np.arange(FIRST_ROWS, len(c))):
                self._add_sparse(c_ids[part], c.take(part))
            return
        block, held = _Postings(c), []
        for i in range(len(self.q)):
            j, score = block.best(self.q[i], self.norms[i], self.least[i], self.k)
            if len(j):
                if len(j) == self.k:
                    self.least[i] = max(self.least[i], score.min())
                held.append((i, j, score))
        if held:
            self._keep(np.repeat([i for i, _, _ in held], [len(j) for _, j, _ in held]),
                       c_ids[np.concatenate([j for _, j, _ in held])], np.concatenate([s for _, _, s in held]))

    def _tile(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query and column numbers and scores of the tile's rows that may stay."""
        with np.errstate(divide="ignore", invalid="ignore"):
            s = self.q @ c.T
            s /= np.outer(self.norms, np.linalg.norm(c, axis=1))
        s[~np.isfinite(s)] = -np.inf
        rows = np.flatnonzero(s.max(axis=1) >= self.least)
        s, n = s[rows], len(c)
        if n <= self.k:
            i, j = np.indices(s.shape).reshape(2, -1)
        else:
            kth = np.partition(s, n - self.k, axis=1)[:, n - self.k]
            self.least[rows] = np.maximum(self.least[rows], kth)
            above, ties = s > kth[:, None], s == kth[:, None]
            ties &= np.cumsum(ties, axis=1, dtype=np.int32) <= (self.k - above.sum(axis=1))[:, None]
            i, j = np.nonzero(above | ties)
        return rows[i], j, s[i, j]

    def _merge(self) -> pd.DataFrame:
        """At most k rows per query: highest score, ties by the smaller corpus id."""
        rows = pd.concat(self.found).sort_values(["_q", "score", self.c_id], ascending=[True, False, True], kind="stable")
        rows = rows.groupby("_q", sort=False).head(self.k)
        full = rows.groupby("_q")["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]["min"]
        at = full.index.to_numpy()
        self.least[at] = np.maximum(self.least[at], full.to_numpy())
        self.found, self.loose = [rows], len(rows)
        return rows

    def rows(self) -> pd.DataFrame:
        rows = self._merge()
        return pd.DataFrame({self.q_id: self.ids[rows["_q"].to_numpy()], self.c_id: rows[self.c_id].to_numpy(),
                             "score": rows["score"].to_numpy()})


class _Postings:
    """The entries of a block of sparse corpus rows by column."""

    def __init__(self, c: _Sparse):
        row = np.repeat(np.arange(len(c)), c.counts)
        values = c.values.astype(np.float64)
        order = np.argsort(c.at, kind="stable")
        ends = np.cumsum(np.bincount(c.at, minlength=c.dim)).tolist()
        self.spans = [slice(a, b) for a, b in zip([0, *ends], ends)]
        self.n, self.row, self.value = len(c), row[order], values[order]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            self.norms = np.sqrt(np.bincount(row, values * values, minlength=self.n))
            self.inverse = 1 / self.norms
        bad = ~(np.isfinite(self.norms) & np.isfinite(self.inverse))
        self.bad = np.flatnonzero(bad) if bad.any() else None  # these have no score
        if self.bad is not None:
            self.norms[bad], self.inverse[bad], self.value[bad[self.row]] = 1, 0, 0

    def best(self, q: np.ndarray, norm: float, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of at most ``k`` rows that score ``least`` or more; no other such row is better."""
        if not (np.isfinite(norm) and norm > 0):
            return np.arange(min(k, self.n)), np.full(min(k, self.n), -np.inf)
        dims = np.flatnonzero(q).tolist()
        lifted = np.concatenate([w * self.value[self.spans[d]] for d, w in zip(dims, q[dims].tolist())])
        dots = np.bincount(np.concatenate([self.row[self.spans[d]] for d in dims]), lifted, minlength=self.n)
        near = dots * self.inverse  # the scores times the norm, but for their rounding
        if self.bad is not None:
            near[self.bad] = -np.inf
        if least == -np.inf and self.n > k:
            j = np.flatnonzero(near >= np.partition(near, self.n - k)[self.n - k] - SLACK * norm)
        else:
            j = np.flatnonzero(near >= (least - SLACK) * norm)
        scores = np.where(near[j] == -np.inf, -np.inf, dots[j] / (norm * self.norms[j]))
        stay = scores >= least
        j, scores = j[stay], scores[stay]
        if len(j) > k:
            kth = np.partition(scores, len(j) - k)[len(j) - k]
            above = scores > kth
            stay = np.sort(np.concatenate([np.flatnonzero(above), np.flatnonzero(scores == kth)[:k - above.sum()]]))
            j, scores = j[stay], scores[stay]
        return j, scores


def top_k(queries: DataFrame, corpus: DataFrame, k: int = C.RETRIEVAL_TOP_K,
          q_id: str = "query_id", c_id: str = "doc_id", vec: str = "vector",
          query_block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """Exact k nearest corpus rows by cosine for every query.

    Queries whose measured size is at most ``query_block_bytes`` go to all
    tasks as one broadcast, and the corpus stays where it lies. More queries
    are never brought to the driver: queries (in groups of that size) and
    corpus rows (in parts) are dealt to one task for each group and part,
    which holds its queries and streams its rows. Either way a task keeps k
    rows per query, and a row_number per query merges the tasks' lists.
    Output: q_id, c_id, score (cosine, double), rank (1..k).
    """
    q_type = queries.schema[q_id].dataType.simpleString()
    c_type = corpus.schema[c_id].dataType.simpleString()
    schema = f"{q_id} {q_type}, {c_id} {c_type}, score double"
    size = queries.agg(F.sum(F.size(vec).cast("long") * 8)).first()[0] or 0
    if size <= query_block_bytes:
        cand = _beside_broadcast(queries.select(q_id, vec), corpus.select(c_id, vec), k, schema)
    else:
        cand = _by_task(queries.select(q_id, vec), corpus.select(c_id, vec), k, schema, -(-size // query_block_bytes))
    w = Window.partitionBy(q_id).orderBy(F.col("score").desc(), F.col(c_id).asc())
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _beside_broadcast(queries: DataFrame, corpus: DataFrame, k: int, schema: str) -> DataFrame:
    spark, (q_id, vec), c_id = queries.sparkSession, queries.columns, corpus.columns[0]
    held = queries.collect()  # at most QUERY_BLOCK_BYTES, measured
    if not held:
        return spark.createDataFrame([], schema)
    kind = object if queries.schema[q_id].dataType.simpleString() == "string" else None
    shared = spark.sparkContext.broadcast((np.array([r[0] for r in held], dtype=kind), np.array([r[1] for r in held], dtype=np.float64)))

    def score(batches):
        best = _Best(*shared.value, k, q_id, c_id)
        for pdf in batches:
            best.add(pdf[c_id].to_numpy(), pdf[vec])
        if best.found:
            yield best.rows()

    return corpus.mapInPandas(score, schema)


def _by_task(queries: DataFrame, corpus: DataFrame, k: int, schema: str, groups: int) -> DataFrame:
    """Queries are packed into one block a group, corpus rows into blocks of each part, and both are dealt once: what
    lies on disk is each vector's values once, not a copy for every task. A task for each part and group streams the
    part's blocks past the group's."""
    q_id, c_id = queries.columns[0], corpus.columns[0]
    rows, cores = corpus.count(), queries.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-TASKS_PER_CORE * cores // groups), -(-rows // CORPUS_PART_ROWS))
    kinds = {"q": _kind(queries), "c": _kind(corpus)}
    group = F.pmod(F.xxhash64(q_id), F.lit(groups)).cast("int")
    part = F.pmod(F.xxhash64(c_id), F.lit(parts)).cast("int")
    held = _packed(queries.repartitionById(groups, group), group, "q").repartitionById(groups, "_q_to")
    dealt = _packed(corpus, part, "c", BLOCK_BYTES).repartitionById(parts, "_c_to")

    def score(batches):
        best, ids, waiting = None, [], []

        def add():
            if ids:
                best.add(np.concatenate(ids), _Sparse.joined(waiting))
                ids.clear()
                waiting.clear()

        for batch in batches:
            for at in range(batch.num_rows):
                if best is None:
                    q_type, c_type = (batch.column(f"_{x}_ids").type.value_type for x in "qc")
                    q_ids, q = _unpacked(batch, at, "q", kinds["q"])
                    q = (q.dense() if isinstance(q, _Sparse) else q).astype(np.float64)
                    best = _Best(q_ids, q, k, q_id, c_id)
                c_ids, c = _unpacked(batch, at, "c", kinds["c"])
                if not isinstance(c, _Sparse):
                    best.add(c_ids, c)
                    continue
                ids.append(c_ids)
                waiting.append(c)
                if sum(map(len, waiting)) >= BLOCK_ROWS:
                    add()
        if best is not None:
            add()
            out = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(out[q_id].tolist(), q_type), pa.array(out[c_id].tolist(), c_type),
                                              pa.array(out["score"].to_numpy(), pa.float64())], [q_id, c_id, "score"])

    return dealt.hint("shuffle_replicate_nl").crossJoin(held).mapInArrow(score, schema)


def _kind(df: DataFrame) -> type:
    return np.float32 if df.schema[df.columns[1]].dataType.simpleString() == "array<float>" else np.float64


def _packed(df: DataFrame, to, side: str, most_bytes: int | None = None) -> DataFrame:
    """(id, vector) rows as blocks for each number ``to``, of about ``most_bytes`` at most: ids, columns, and the
    vectors' values other than 0 with their columns, or all values if that is shorter."""
    key, vec = df.columns
    kind = _kind(df)
    names = [f"_{side}_{x}" for x in ("to", "ids", "dim", "counts", "at", "values")]
    types = ["int", f"array<{df.schema[key].dataType.simpleString()}>", "int", "binary", "binary", "binary"]

    def pack(batches):
        waiting, size = {}, 0  # by number: ids and vectors
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column(2).value_lengths()
            if lengths.null_count or len(lengths.unique()) > 1:
                raise ValueError("vectors of different lengths")
            m = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(batch.num_rows, -1)
            numbers = batch.column(0).to_numpy()
            for n in np.unique(numbers).tolist():
                here = np.flatnonzero(numbers == n)
                rows = _Sparse.of(m[here])
                waiting.setdefault(n, []).append((batch.column(1).take(pa.array(here)), rows))
                size += len(rows.values) * (kind().nbytes + 4) + len(here) * 24
            if most_bytes and size >= most_bytes:
                yield from map(block, waiting.items())
                waiting, size = {}, 0
        yield from map(block, waiting.items())

    def block(item):
        number, held = item
        ids, rows = pa.concat_arrays([i for i, _ in held]), _Sparse.joined([r for _, r in held])
        short = len(rows.values) * (kind().nbytes + 4) < len(rows) * rows.dim * kind().nbytes
        counts, at = (rows.counts.astype(np.int32).tobytes(), rows.at.astype(np.int32).tobytes()) if short else (None, None)
        values = (rows.values if short else rows.dense()).tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([rows.dim], pa.int32()),
             *(pa.array([x], pa.binary()) for x in (counts, at, values))], names)

    vector = F.col(vec).cast("array<float>" if kind is np.float32 else "array<double>").alias("_v")
    return df.select(to.alias("_to"), F.col(key).alias("_id"), vector).mapInArrow(pack, ", ".join(map(" ".join, zip(names, types))))


def _unpacked(batch: pa.RecordBatch, at: int, side: str, kind: type) -> tuple[np.ndarray, np.ndarray | _Sparse]:
    ids, dim, counts, columns, values = (batch.column(f"_{side}_{x}")[at] for x in ("ids", "dim", "counts", "at", "values"))
    keys, dim = ids.values.to_numpy(zero_copy_only=False), dim.as_py()
    if not counts.is_valid:
        return keys, np.frombuffer(values.as_buffer(), kind).reshape(len(keys), dim)
    return keys, _Sparse(np.frombuffer(counts.as_buffer(), np.int32).astype(np.int64),
                         np.frombuffer(columns.as_buffer(), np.int32), np.frombuffer(values.as_buffer(), kind), dim)


def retrieval_checks(questions: DataFrame, docs: DataFrame, hits: DataFrame, prompts: DataFrame, synced: DataFrame,
                     k: int = C.RETRIEVAL_TOP_K) -> DataFrame:
    """Facts that hold for any embedding, one row per check: (check, expected, actual)."""
    n_q, n_d = (df.agg(F.count(F.lit(1))).scalar() for df in (questions, docs))
    expected_hits = n_q * F.least(F.lit(k).cast("long"), n_d)
    facts = hits.agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("ranks"),
                     F.count_if(F.col("score").between(-1.000001, 1.000001)).alias("cosines"))
    rows = [("hits per question", expected_hits, facts.select("n").scalar()),
            ("ranks 1..k", n_q * F.least(F.lit(k).cast("long"), n_d) * (F.least(F.lit(k).cast("long"), n_d) + 1) / 2,
             facts.select("ranks").scalar()),
            ("cosines in -1..1", expected_hits, facts.select("cosines").scalar()),
            ("one prompt per question", n_q, prompts.agg(F.count(F.lit(1))).scalar()),
            ("one vector per document after the sync", n_d, synced.agg(F.count_distinct("doc_id")).scalar())]
    base = docs.sparkSession.range(1)
    return base.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), e.cast("long").alias("expected"),
                                                   a.cast("long").alias("actual")) for c, e, a in rows])))


def assemble_context(questions: DataFrame, hits: DataFrame, docs: DataFrame,
                     q_id: str = "question_id", c_id: str = "doc_id") -> DataFrame:
    """Per question, the hit documents in rank order joined by a blank
    line; a question without hits gets the fixed fallback text."""
    texts = hits.join(docs.select(c_id, "document"), c_id)
    ctx = (texts.groupBy(q_id)
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document"))),
                                         lambda s: s["document"]), C.CONTEXT_SEP).alias("context")))
    return (questions.join(ctx, q_id, "left")
            .withColumn("context", F.coalesce(F.col("context"), F.lit(C.NO_CONTEXT_TEXT))))


def rag_prompts(contexts: DataFrame, question_col: str = "question") -> DataFrame:
    """The retrieval prompt for each question."""
    return contexts.withColumn("prompt", F.format_string(C.RAG_PROMPT_TEMPLATE, F.col("context"),
                                                         F.col(question_col)))


def label_centroids(embeddings: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per label (double): one map-side-combined vector aggregate."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = embeddings.select(label, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    return (rows.groupBy(label).agg(Summarizer.mean(F.col("_v")).alias("_m"))
            .select(label, vector_to_array("_m").alias("vector")))
