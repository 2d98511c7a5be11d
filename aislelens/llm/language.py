"""Language ID (operator 10): script ranges, word scores, Viterbi over the words of a text.

A word is a run of letters. Its script narrows the candidates to the languages that use the script in the learnt
texts; its score for a language is the sum of log frequencies of its letters with their neighbours (hashed to
BUCKETS values; word ends count as neighbours). Viterbi over the words of a whole text, with a penalty for each
change of language, labels spans of mixed-language text. The text's language is the one with most letters in its
spans, and its score is their share of all letters.

Counts cover all learnt documents: each task adds up its own, Spark sums them by (language, bucket), and the result
is at most BUCKETS + 64 numbers per language, so the model that is broadcast is bounded by the languages.

Defined results: null text or text without a letter is ``und`` with score 0, and so is every text if nothing could
be learnt; text with letters only in scripts that no learnt language uses gets the language learnt from most
letters, with score 0. Rows without lang or doc_id are not learnt from. Repeated rows get equal results; extra columns are
left aside by ``identify`` and kept by ``keep_known``; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: First code points of ranges of letters of one script (Unicode blocks), and the script's number.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "syriac"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"),
    (0x1400, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1D00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"),
    (0xA800, "other"), (0xAB30, "latin"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "other"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"),
    (0x20000, "han"),
)

BUCKETS = 1 << 16
#: Penalty of a change of language, in units of log probability.
SWITCH = 12.0
SMOOTHING = 0.5
#: A language is a candidate for a script that has at least this share of its letters.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"
#: Code points scored at once, and words in one run of Viterbi (documents side by side).
SLICE = 1 << 20
WORDS = 1 << 20


class _Letters:
    """Tables over all code points, made once per worker."""

    made = None

    def __init__(self):
        names = sorted({name for _, name in SCRIPTS})
        self.n_scripts = len(names)
        starts = [a for a, _ in SCRIPTS]
        number = [names.index(name) for _, name in SCRIPTS]
        points = 0x110000
        self.script = np.zeros(points, np.uint8)
        for k, a in enumerate(starts):
            self.script[a:starts[k + 1] if k + 1 < len(starts) else points] = number[k]
        self.lower = np.zeros(points, np.uint32)  # 0: no letter
        for c in range(points):
            x = chr(c)
            if x.isalpha():
                y = x.lower()
                self.lower[c] = ord(y) if len(y) == 1 else c

    @classmethod
    def get(cls) -> _Letters:
        cls.made = cls.made or cls()
        return cls.made


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _buckets(low: np.ndarray) -> np.ndarray:
    """A bucket per code point from it and its neighbours; ``low`` starts and ends with a 0."""
    x = (low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA77) + np.uint32(0x165667B1))
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) ^ (low[2:] * np.uint32(0xC2B2AE3D))
    return (((x ^ (x >> np.uint32(13))) * np.uint32(0x297A2D39)) >> np.uint32(16)).astype(np.int64)


def _scan(points: np.ndarray, letters: _Letters) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of a text's lower-cased letters with a 0 or the true neighbour at either end, cut between words."""
    low = letters.lower[points]
    at, n = 0, len(low)
    while at < n:
        end = min(at + SLICE, n)
        if end < n:
            gaps = np.flatnonzero(low[at:end] == 0)
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word beyond the slice: up to its end
                more = np.flatnonzero(low[end:] == 0)
                end = end + int(more[0]) + 1 if len(more) else n
        yield at, np.concatenate([[0], low[at:end], [0]]).astype(np.uint32)
        at = end


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all documents that have a lang; buckets from BUCKETS on count letters by script."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _Letters.get()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS + letters.n_scripts, np.int64)
                points = _points(text.as_py())
                for at, low in _scan(points, letters):
                    there = low[1:-1] > 0
                    found = _buckets(low)[there]
                    if len(found) > BUCKETS:
                        sums[lang][:BUCKETS] += np.bincount(found, minlength=BUCKETS)
                    else:
                        np.add.at(sums[lang], found, 1)
                    scripts = letters.script[points[at:at + len(low) - 2][there]]
                    sums[lang][BUCKETS:] += np.bincount(scripts, minlength=letters.n_scripts)
        for lang, n in sums.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k, pa.int64()), pa.array(n[k], pa.int64())],
                                             ["lang", "bucket", "n"])

    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("lang").cast("string"), F.col("text").cast("string"))
    return (rows.mapInArrow(count, "lang string, bucket long, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


class Model:
    """Log frequencies (bucket x language), candidates (script x language), languages by code point."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        n_scripts = len({name for _, name in SCRIPTS})
        n = np.zeros((BUCKETS + n_scripts, len(self.langs)))
        for lang, bucket, k in rows:
            n[bucket, bisect.bisect_left(self.langs, lang)] = k
        known, scripts = n[:BUCKETS], n[BUCKETS:]
        self.logs = np.log((known + SMOOTHING) / (known.sum(0) + SMOOTHING * BUCKETS)).astype(np.float32)
        self.candidates = scripts > SCRIPT_SHARE * scripts.sum(0)
        self.most = int(np.argmax(known.sum(0))) if self.langs else -1


def fit(docs: DataFrame) -> Model:
    """Learns from the text and lang of ``docs``; collects at most BUCKETS + 64 rows per language."""
    return Model([(r.lang, r.bucket, r.n) for r in counts(docs).collect()])


IMPOSSIBLE = np.float32(-1e6)


def _words(texts: list[str], model: Model, letters: _Letters):
    """Per word of all texts: scores, start, end (code points in its text), known (has a candidate); words per text."""
    scores, starts, ends, known, per_text = [], [], [], [], []
    for text in texts:
        points, n = _points(text), 0
        for at, low in _scan(points, letters):
            letter = (low > 0).astype(np.int8)
            step = np.diff(letter)
            a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)  # in the slice without its first 0
            if not len(a):
                continue
            rows = model.logs[_buckets(low)[low[1:-1] > 0]]
            first = np.concatenate([[0], np.cumsum(b - a)[:-1]])
            score = np.add.reduceat(rows, first, axis=0)
            allowed = model.candidates[letters.script[points[at + a]]]
            some = allowed.any(1)
            score[some[:, None] & ~allowed] = IMPOSSIBLE
            score[~some] = 0
            scores.append(score)
            starts.append(a + at)
            ends.append(b + at)
            known.append(some)
            n += len(a)
        per_text.append(n)
    if not scores:
        none = np.zeros(0, np.int64)
        return np.zeros((0, len(model.langs)), np.float32), none, none, none.astype(bool), np.array(per_text, np.int64)
    return np.concatenate(scores), *map(np.concatenate, (starts, ends, known)), np.array(per_text, np.int64)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each row of ``scores``, for sequences of the given lengths one after another.

    All sequences step together, longest first, so a step is a few operations over those that still run.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    labels = np.zeros(len(scores), np.int64)
    if not len(scores):
        return labels
    came = np.zeros(scores.shape, np.uint16)  # the label before
    steps = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # sequences longer than t
    best = np.zeros((len(sizes), scores.shape[1]), np.float64)
    own = np.arange(scores.shape[1], dtype=np.uint16)
    for t in range(steps):
        k = active[t]
        at = starts[:k] + t
        now = best[:k]
        if t:
            top = now.argmax(1)
            jump = now[np.arange(k), top][:, None] - switch
            stay = now >= jump
            came[at] = np.where(stay, own, top[:, None].astype(np.uint16))
            now = np.where(stay, now, jump)
        best[:k] = now + scores[at]
    label = best.argmax(1)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        labels[at] = label[:k]
        if t:
            label[:k] = came[at, label[:k]]
    return labels


def _label(texts: list[str | None], model: Model, with_spans: bool) -> list[dict]:
    """lang, score and, if asked for, spans of each text; known is the share of letters in spans of any learnt language."""
    if not model.langs:
        return [{"lang_pred": UNKNOWN, "score": 0.0, "known": 0.0, "spans": []} for _ in texts]
    letters = _Letters.get()
    scores, starts, ends, known, per_text = _words([t or "" for t in texts], model, letters)
    labels = viterbi(scores, per_text)
    out, at = [], 0
    for n in per_text.tolist():
        a, b, label, sure = (x[at:at + n] for x in (starts, ends, labels, known))
        at += n
        if not n:
            out.append({"lang_pred": UNKNOWN, "score": 0.0, "known": 0.0, "spans": []})
            continue
        size = b - a
        held = np.bincount(label[sure], weights=size[sure], minlength=len(model.langs))
        top = int(held.argmax()) if held.any() else model.most
        spans = []
        if with_spans:
            label = np.where(sure, label, -1)
            cut = np.flatnonzero(np.diff(label)) + 1
            for i, j in zip([0, *cut], [*cut, n], strict=True):
                spans.append({"lang": model.langs[label[i]] if label[i] >= 0 else UNKNOWN, "start": int(a[i]), "end": int(b[j - 1])})
        out.append({"lang_pred": model.langs[top], "score": float(held[top] / size.sum()),
                    "known": float(held.sum() / size.sum()), "spans": spans})
    return out


def identify(rows: DataFrame, model: Model, key: str = "doc_id", spans: bool = True) -> DataFrame:
    """(key, lang_pred, score, spans) of rows (key, text); a span is (lang, start, end) in code points."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, lang_pred string, score double, spans array<struct<lang:string,start:long,end:long>>"
    fields = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def done(keys, texts):
            found = _label(texts, model, spans)
            return pa.RecordBatch.from_arrays([
                pa.array(keys, batch.schema.field(key).type), pa.array([x["lang_pred"] for x in found], pa.string()),
                pa.array([x["score"] for x in found], pa.float64()), pa.array([x["spans"] for x in found], pa.list_(fields))],
                [key, "lang_pred", "score", "spans"])

        for batch in batches:
            keys, texts, held = [], [], 0
            for k, t in zip(batch.column(key).to_pylist(), batch.column("text"), strict=True):
                keys.append(k)
                texts.append(t.as_py())
                held += len(texts[-1] or "")
                if held > 4 * WORDS:
                    yield done(keys, texts)
                    keys, texts, held = [], [], 0
            if keys:
                yield done(keys, texts)

    return rows.select(key, F.col("text").cast("string")).mapInArrow(label, schema)


def _learnt(docs: DataFrame) -> Model:
    return fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))


#: keep_known rejects a text of which less than this share of letters is in spans of learnt languages.
LEAST_SCORE = 0.2


def _has_letters(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def keep_known(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` with a language: rejected are texts without letters and texts whose letters are
    hardly in any learnt language (if nothing could be learnt, texts without letters alone)."""
    shared = docs.sparkSession.sparkContext.broadcast(_learnt(docs))
    text_at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            done, texts, held = 0, [], 0
            for k, t in enumerate(batch.column(text_at)):
                texts.append(t.as_py())
                held += len(texts[-1] or "")
                if held > 4 * WORDS or k + 1 == batch.num_rows:
                    if model.langs:
                        found = _label(texts, model, False)
                        stay = [x["lang_pred"] != UNKNOWN and x["known"] >= least_score for x in found]
                    else:
                        stay = [_has_letters(t) for t in texts]
                    yield batch.slice(done, len(texts)).filter(pa.array(stay, pa.bool_()))
                    done, texts, held = k + 1, [], 0

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document's language."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, _learnt(docs), spans=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
