"""Secret scans (operator 2): patterns, and a linear-chain conditional random field over the words of a text.

The patterns find the base spans, which always stay. The field tags each word as the beginning (B) or inside (I) of
a secret value or outside (O), from the word's shape, the classes of the two words before and the one after, and
features of the whole text; Viterbi decodes whole texts. Tagged words that meet no base span are added as kind
``crf``, without quotes and sentence signs around them.

The field is trained by penalised maximum likelihood on a bounded sample (about SAMPLE_DOCS plain texts and
SAMPLE_VALUED texts with base values, by a hash of the row; of a text over SAMPLE_BYTES the surroundings of its first
value; the bound is on training alone), with the words of base values as labels, on variants of their surroundings, and
on plain texts in which made-up secrets stand in other forms (``FORMS``); windows around assignments that are too
short for the patterns are left out, as nobody has judged them. The penalty's mean is a set of fixed weights
(``prior``), which alone are the model where there is no text to learn from. Tagged runs of fewer than LEAST_ADDED
characters are not added: so few signs tell no secret from a word.

Defined results: null text is empty and has no spans; repeated rows are scanned each; an empty table gives an
empty result. Extra columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

#: Fixed values of the contract: kinds in their order, patterns, least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Texts with a base value, as a Java pattern.
VALUED = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""
          r"|AKIA[A-Z0-9]{14}|[0-9a-f]{16}")
KINDS = ("assign", "access", "hex", "crf")

#: What a text must hold, in bytes of lower case, for a pattern to match at all.
ASSIGN_SIGNS = (b"password", b"passwd", b"secret", b"token", b"api")
HEX_MASK = bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))

#: Parts of words that name a secret.
NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "auth",
         "bearer", "access_key", "private_key", "passphrase", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-")
#: Forms of secrets beside the base ones: {n} a name, {v} a value, {t} a value that begins as tokens do.
FORMS = ("{n} = {v}", "{n}: {v}", "{n} = \"{v}\"", "{n}={v}", "{n}: '{v}'", "Authorization: Bearer {v}", "Bearer {v}", "{n} is {v}",
         "the {n} is {v}", "{t}", "{t}", "{n} {t}", "{v24}", "{v24}")
STARTS_OF_TOKENS = ("ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-")

SAMPLE_DOCS = 2000
SAMPLE_VALUED = 500
SAMPLE_BYTES = 1 << 16
#: How much more likely a tagging with a value must be than one without, in log units.
MARGIN = 2.5
OWN_MARGIN_WINDOWS = 200
#: Made-up forms of each base assignment of the sample.
VARIANTS = 4
#: Words on either side of a value that a training window holds; a shorter text is one window.
WINDOW = 12
ROUNDS = 60
RATE = 0.3
#: Of the squared distance from the prior's weights, over all windows.
PENALTY = 4.0
#: Characters of a group of texts, and least characters of an added span.
GROUP = 4 << 20
LEAST_ADDED = 8
AROUND = "\"'`()[]{}<>,;.!?"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by start, then kind."""
    data = text.encode()
    low = data.lower()
    out = []
    if any(s in low for s in ASSIGN_SIGNS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in data:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if b"\x01" * LEAST["hex"] in data.translate(HEX_MASK):
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(out, key=lambda s: (s[0], s[2]))


# --- features -------------------------------------------------------------------------------------------------

#: Upper ends of the ranges that lengths, shares and counts fall in.
LENGTHS = np.array([2, 3, 4, 6, 8, 10, 12, 16, 20, 32, 48])
SHARES = np.array([1e-9, 0.2, 0.5, 0.9, 1.0])
SWITCHES = np.array([1, 2, 3, 6, 12])
#: Number of values of each slot of a word's own features.
SLOTS = (12, 6, 6, 6, 6, 2, 16, 72, 32)
CLASSES = 8
TAGS = 3


def _classes() -> np.ndarray:
    out = np.full(256, 4, np.uint8)  # 0 digit, 1 lower, 2 upper, 3 sign, 4 beyond ASCII
    out[:128] = 3
    out[48:58], out[97:123], out[65:91] = 0, 1, 2
    return out


CLASS_OF = _classes()


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Own feature values (word x slot) and the class (0..7) that neighbours see, of distinct words."""
    n = len(words)
    data = np.frombuffer(b"".join(w.encode() for w in words.to_pylist()), np.uint8)
    size = pc.binary_length(words).to_numpy().astype(np.int64)
    start = np.cumsum(size) - size

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int64), start) if n else np.zeros(0, np.int64)

    kind = CLASS_OF[data]
    digit, lower, upper, sign, other = (per_word(kind == k) for k in range(5))
    is_hex = per_word(np.frombuffer(HEX_MASK, np.uint8)[data]) + per_word((data >= 65) & (data <= 70))
    change = np.concatenate([[False], kind[1:] != kind[:-1]])
    change[start] = False
    switches = np.digitize(per_word(change), SWITCHES)
    length = np.digitize(size, LENGTHS)
    share = lambda x: np.digitize(x / size, SHARES)
    last, first = (data[start + size - 1], data[start]) if n else (data, data)
    quoted = (first == 34) | (first == 39)
    ends = (last == 61) | (last == 58)
    joined = (per_word((data == 61) | (data == 58)) > 0) & ~ends
    low = pc.ascii_lower(words)
    named = np.zeros(n, bool)
    for name in NAMES:
        named |= pc.match_substring(low, name).to_numpy(zero_copy_only=False)
    bare = sign == size
    own = np.stack([length, share(digit), share(upper), share(lower), switches, (is_hex == size - sign) & (size > sign),
                    8 * quoted + 4 * ends + 2 * joined + (other > 0), 6 * length + switches,
                    16 * named + 8 * joined + np.minimum(length, 7)], 1).astype(np.int64)
    return own, (4 * named + 2 * ends + bare).astype(np.int64)


def text_features(cls: np.ndarray, own: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """A value 0..15 per text: how many words it has, and the share of them with digits."""
    ends = np.concatenate([[0], np.cumsum(own[:, 1] > 0)])
    cuts = np.concatenate([[0], np.cumsum(per_text)])
    digits = np.diff(ends[cuts]) / np.maximum(per_text, 1)
    return 4 * np.digitize(per_text, (50, 300, 2000)) + np.digitize(digits, (0.001, 0.02, 0.1))


def _around(cls: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word: the joint class of the two before, and the class of the next (CLASSES beyond the text's ends)."""
    none = CLASSES
    starts = np.cumsum(per_text) - per_text
    at = np.arange(len(cls)) - np.repeat(starts, per_text)
    left = np.repeat(per_text, per_text) - at
    one = np.where(at >= 1, np.roll(cls, 1), none)
    two = np.where(at >= 2, np.roll(cls, 2), none)
    return one * (CLASSES + 1) + two, np.where(left > 1, np.roll(cls, -1), none)


#: Where each group of weights begins: own slots, the two words before, the next word, the text.
STARTS = np.concatenate([[0], np.cumsum([*SLOTS, (CLASSES + 1) ** 2, CLASSES + 1, 16])])


def split_words(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word of all texts, and the words per text."""
    words = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
    flat, per_text = words.flatten(), pc.list_value_length(words).to_numpy()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():  # white space at an end leaves an empty word
        ends = np.concatenate([[0], np.cumsum(full)])
        per_text, flat = np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])]), flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), per_text


class Field:
    """Weights (feature value x tag) and transitions (tag x tag), in log units."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word of all texts the scores of its tags; the words per text."""
        w = self.weights
        words, which, per_text = split_words(texts)
        own, cls = word_features(words)
        table = sum((w[STARTS[k] + own[:, k]] for k in range(len(SLOTS))), np.zeros((len(words), TAGS)))
        before, after = _around(cls[which], per_text)
        file = text_features(cls, own[which], per_text)
        k = len(SLOTS)
        out = table[which]
        out += w[STARTS[k] + before]
        out += w[STARTS[k + 1] + after]
        out += np.repeat(w[STARTS[k + 2] + file], per_text, axis=0)
        return out, per_text


def viterbi(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The best tags of sequences one after another; all step together, longest first."""
    tags = np.zeros(len(scores), np.int8)
    if not len(scores):
        return tags
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
    came = np.zeros(scores.shape, np.int8)
    best = scores[starts[:active[0]]].copy()
    for t in range(1, len(active)):
        k = active[t]
        at = starts[:k] + t
        ways = best[:k, :, None] + transitions
        came[at] = ways.argmax(1)
        best[:k] = ways.max(1) + scores[at]
    tag = best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        tags[at] = tag[:k]
        if t:
            tag[:k] = came[at, tag[:k]]
    return tags


# --- training -------------------------------------------------------------------------------------------------

def _labels(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Tags of the words by base values, and whether a word is in an assignment too short for the patterns."""
    spans = list(re.finditer(WORD, text))
    starts, ends = np.array([m.start() for m in spans], np.int64), np.array([m.end() for m in spans], np.int64)
    tags, unsure = np.zeros(len(spans), np.int8), np.zeros(len(spans), bool)
    values = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    values += [s[:2] for s in base_spans(text) if s[2] > 0]
    for a, b in sorted(values):
        i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        tags[i:j] = np.where(np.arange(i, j) == i, 1, 2)
    for m in ASSIGN.finditer(text):
        if len(m[2]) < LEAST["assign"]:
            unsure[np.searchsorted(ends, m.start(2), "right"):np.searchsorted(starts, m.end(2), "left")] = True
    return tags, unsure & (tags == 0)


def _varied(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """Surroundings of base assignments with other names, marks and values (VARIANTS each), and their tags: the
    field shall learn what stands around a secret, not the one form that the sample may hold."""
    rng = np.random.Generator(np.random.Philox(2))
    signs = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    out, tags = [], []
    for text in texts:
        for m in ASSIGN.finditer(text):
            if len(m[2]) < LEAST["assign"]:
                continue
            left, right = text[:m.start()].split()[-WINDOW - 2:], text[m.end(2):].split()[1:WINDOW + 3]
            for _ in range(VARIANTS):
                value = "".join(rng.choice(signs[:(62, 36)[rng.integers(2)]], rng.integers(8, 40)))
                name = NAMES[rng.integers(len(NAMES))]
                mark = ("{} = \"{}\"", "{}: {}", "{} = {}", "{}: '{}'")[rng.integers(4)]
                own = mark.format(name, value).split()
                out.append(" ".join([*left, *own, *right]))
                tags.append(np.array([0] * len(left) + [int(value in w) for w in own] + [0] * len(right), np.int8))
    return out, tags


def _planted(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """Windows of plain texts with a made-up secret each, in one of FORMS, and their tags."""
    rng = np.random.Generator(np.random.Philox(4))
    signs = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    out, tags = [], []
    for text in texts:
        around = text.split()
        at = int(rng.integers(len(around) + 1))
        value = "".join(rng.choice(signs[:(62, 36)[rng.integers(2)]], rng.integers(9, 40)))
        long = "".join(rng.choice(signs, rng.integers(20, 41)))
        name = NAMES[rng.integers(14)]
        token = STARTS_OF_TOKENS[rng.integers(len(STARTS_OF_TOKENS))] + long
        form = FORMS[rng.integers(len(FORMS))]
        own = form.format(n=name if rng.random() < 0.7 else name.capitalize(), v=value, t=token, v24=long).split()
        left, right = around[max(0, at - WINDOW - 2):at], around[at:at + WINDOW + 3]
        out.append(" ".join([*left, *own, *right]))
        tags.append(np.array([0] * len(left) + [int(value in w or long in w) for w in own] + [0] * len(right), np.int8))
    return out, tags


def prior() -> Field:
    """Fixed weights, the mean of the penalty: a value has digits, changes between classes of signs and eight
    signs at least, and stands behind a name with its mark, or is joined to it."""
    w = np.zeros((STARTS[-1], TAGS))
    n = len(SLOTS)
    w[STARTS[n + 2]:, 0] = 4.5
    w[:, 2][STARTS[n + 2]:] = -4
    for k, low, at_least, below in ((0, 5, 1, -4), (1, 1, 1, 0), (4, 2, 1, 0)):  # length, digits, switches
        w[STARTS[k]:STARTS[k] + low, 1], w[STARTS[k] + low:STARTS[k] + SLOTS[k], 1] = below, at_least
    w[STARTS[8] + 16 + 8 + 7, 1] = 3  # named and joined, twelve signs or more
    for one in range(CLASSES):
        for two in range(CLASSES + 1):
            mark_apart = one & 3 == 3 and two < CLASSES and two & 4
            if one & 6 == 6 or mark_apart:
                w[STARTS[n] + one * (CLASSES + 1) + two, 1] = 3
    return Field(w, np.array([[0, 0, -20], [0, 0, 0], [0, 0, 0]], float))


def fit(texts: list[str]) -> Field:
    """Penalised maximum likelihood over windows around values and as many others, by Adam on the exact gradient."""
    start = prior()
    labels = [_labels(t) for t in texts]
    more, their = _varied(texts)
    put, tags_put = _planted([t for t, (y, unsure) in zip(texts, labels, strict=True) if not y.any() and not unsure.any()])
    texts, labels = texts + more + put, labels + [(t, np.zeros(len(t), bool)) for t in their + tags_put]
    words, which, per_text = split_words(texts)
    own, cls = word_features(words)
    before, after = _around(cls[which], per_text)
    file = np.repeat(text_features(cls, own[:, :2].astype(np.int8)[which], per_text), per_text)
    k = len(SLOTS)

    def values(at: np.ndarray) -> np.ndarray:  # of the windows' words alone: texts are long
        return np.concatenate([STARTS[:k] + own[which[at]], (STARTS[k] + before[at])[..., None], (STARTS[k + 1] + after[at])[..., None],
                               (STARTS[k + 2] + file[at])[..., None]], -1)

    tags = np.concatenate([x[0] for x in labels]) if labels else np.zeros(0, np.int8)
    unsure = np.concatenate([x[1] for x in labels]) if labels else np.zeros(0, bool)
    length = 2 * WINDOW + 1
    starts: dict[int, list[int]] = {}  # of windows, by their length
    for a, n in zip((np.cumsum(per_text) - per_text).tolist(), per_text.tolist(), strict=True):
        if n >= length:
            marked = np.flatnonzero(tags[a:a + n] == 1)
            plain = n * 7919 % (n - length + 1)  # and one window of every text
            starts.setdefault(length, []).extend(a + int(min(max(m - WINDOW, 0), n - length)) for m in [*marked, plain + WINDOW])
        elif n:
            starts.setdefault(n, []).append(a)
    weights, transitions = start.weights.copy(), start.transitions.copy()
    pairs = np.zeros((TAGS, TAGS))
    groups = []  # window x word x slot, (window and word) x tag
    for size, first in sorted(starts.items()):
        at = np.unique(np.array(first, np.int64))[:, None] + np.arange(size)
        at = at[~unsure[at].any(1)]
        y = tags[at]
        np.add.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        if len(at):
            groups.append((values(at), np.eye(TAGS)[y]))
    if not groups:
        return start
    flat = np.concatenate([x.reshape(-1, x.shape[2]) for x, _ in groups])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, transitions)]
    scale = 1 / sum(len(x) for x, _ in groups)
    for step in range(1, ROUNDS + 1):
        diffs, p_pair = [], np.zeros((TAGS, TAGS))
        for x, one_hot in groups:
            p_word, p_pairs = marginals(weights[x].sum(2), transitions)
            diffs.append((one_hot - p_word).reshape(-1, TAGS))
            p_pair += p_pairs
        diff = np.concatenate(diffs)
        g = np.zeros_like(weights)
        for s in range(flat.shape[1]):
            for t in range(TAGS):
                g[:, t] += np.bincount(flat[:, s], weights=diff[:, t], minlength=len(g))
        grads = ((g - PENALTY * (weights - start.weights)) * scale, (pairs - p_pair - PENALTY * (transitions - start.transitions)) * scale)
        for p, grad, (m, v) in zip((weights, transitions), grads, moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            p += RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    transitions[0, 2] = -20  # a value begins with B
    # whatever the text; the prior has a margin of its own, which the fit outgrows as windows come in
    weights[STARTS[len(SLOTS) + 2]:, 0] += MARGIN / (1 + OWN_MARGIN_WINDOWS * scale)
    return Field(weights, transitions)


def marginals(scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over sequences of one length: tag probabilities, and expected transitions over all."""
    n, length, tags = scores.shape
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0]

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

    for t in range(1, length):
        ahead[:, t] = log_sum(ahead[:, t - 1, :, None] + transitions, 1) + scores[:, t]
    for t in range(length - 2, -1, -1):
        behind[:, t] = log_sum(transitions + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
    total = log_sum(ahead[:, -1], 1)
    pairs = np.zeros((tags, tags))
    for t in range(length - 1):
        joint = ahead[:, t, :, None] + transitions + (scores[:, t + 1] + behind[:, t + 1])[:, None, :]
        pairs += np.exp(joint - total[:, None, None]).sum(0)
    return np.exp(ahead + behind - total[:, None, None]), pairs


def train(docs: DataFrame) -> Field:
    """Trains on the driver, over the bounded sample."""
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id"))
    size = F.octet_length("text")
    rows = rows.withColumn("h", F.pmod(F.xxhash64("doc_id", size), F.lit(1 << 20)))
    valued = F.col("text").rlike(VALUED)
    n = rows.agg(F.count("*").alias("all"), F.count_if(valued).alias("valued")).first()

    def share(most: int, of: int) -> int:
        return int(min(1.0, most / max(of, 1)) * (1 << 20)) + 1

    # of a long text the signs from a little before its first value on, or its first ones
    first = F.greatest(F.lit(1), F.regexp_instr("text", F.lit(VALUED)) - SAMPLE_BYTES // 16)
    piece = F.when(size <= SAMPLE_BYTES, F.col("text")).otherwise(F.substring("text", first, F.lit(SAMPLE_BYTES // 4)))
    plain = rows.filter((F.col("h") < share(SAMPLE_DOCS, n["all"])) & ~valued).limit(2 * SAMPLE_DOCS)
    some = rows.filter((F.col("h") < share(SAMPLE_VALUED, n["valued"])) & valued).limit(2 * SAMPLE_VALUED)
    texts = [r.text for r in some.union(plain).select(piece.alias("text")).collect()]
    return fit(sorted(texts))


# --- scan -----------------------------------------------------------------------------------------------------

def _added(text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Tagged runs of words that meet no base span."""
    places = [m.span() for m in re.finditer(WORD, text)]
    out, k = [], 0
    while k < len(tags):
        if not tags[k]:
            k += 1
            continue
        j = k + 1
        while j < len(tags) and tags[j] == 2:
            j += 1
        a, b = places[k][0], places[j - 1][1]
        k = j
        while a < b and text[a] in AROUND:
            a += 1
        while b > a and text[b - 1] in AROUND:
            b -= 1
        if b - a >= LEAST_ADDED and not any(a < e and s < b for s, e, _ in base):
            out.append((a, b, 3))
    return out


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, spans): all spans of each text as (kind, start, end), by start, then kind."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value

        def done(ids: list, texts: list[str]) -> pa.RecordBatch:
            found = [base_spans(t) for t in texts]
            scores, per_text = field.scores(texts)
            tags, ends = viterbi(scores, per_text, field.transitions), np.cumsum(per_text)
            marked = np.concatenate([[0], np.cumsum(tags > 0)])
            hit = np.flatnonzero(marked[ends] > marked[ends - per_text])
            for k in hit:
                found[k] = sorted(found[k] + _added(texts[k], tags[ends[k] - per_text[k]:ends[k]], found[k]),
                                  key=lambda s: (s[0], s[2]))
            spans = [[{"kind": KINDS[c], "start": a, "end": b} for a, b, c in x] for x in found]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, kind)], ["doc_id", "spans"])

        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held > GROUP:
                    yield done(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield done(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        find, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document's spans."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "crf")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
