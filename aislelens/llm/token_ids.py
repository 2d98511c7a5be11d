"""Token ids of whole texts by a public tokenizer, computed inside tasks.

The tokenizer splits at white space before it merges, so a text's ids are the ids of its words one after
another. Arrow splits a batch of texts into words and numbers the distinct ones; only these are looked at in
Python, and of these only the ones that the worker's cache lacks are encoded, many in one call. The ids are then
gathered by the words' numbers. Tests hold this to ``Tokenizer.encode`` of whole texts.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text that are split at once, and words in a generation of a worker's cache (it holds two).
SLICE = 8 << 20
CACHE_WORDS = 300_000
#: Words in one call of the tokenizer.
CALL_WORDS = 2000
#: Letters that no normaliser step turns into anything but one letter, and behind them, before
#: white space, signs that the tokenizer takes as one piece. A space between the two changes no id.
LETTER_SIGNS = r'([A-Za-zÀ-ÖØ-öø-ÿ])([.,!?;:%*#$&|"()]+[ \n]|[.,!?;:%*#$&|"()]+$)'


def vocabulary(spark: SparkSession, path: str | None = None):
    """The tokenizer file (1.6 MB, of fixed size) as a broadcast, so executors need no copy of their own."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


class WordEncoder:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, blob: bytes, cache_words: int = CACHE_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob.decode())
        self.cache_words = cache_words
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        size = self.tokenizer.get_vocab_size()
        #: whether an id ends a piece; all False if the vocabulary has no ends
        self.ends = np.array([bool(suffix) and (self.tokenizer.id_to_token(k) or "").endswith(suffix)
                              for k in range(size)])

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of an Arrow string array; null counts as empty."""
        texts = texts.fill_null("")
        sizes = pc.binary_length(texts).to_numpy()
        at = 0
        while at < len(sizes):
            if sizes[at] > SLICE:
                parts = pa.array([p.decode() for p in text_parts(texts[at].as_py().encode())], pa.string())
                yield np.concatenate([x for k in range(len(parts)) for x in self._group(parts.slice(k, 1))])
                at += 1
                continue
            end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:at + 20_000]), SLICE, "right")))
            yield from self._group(texts.slice(at, end - at))
            at = end

    def _group(self, texts: pa.Array) -> Iterator[np.ndarray]:
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, LETTER_SIGNS, r"\1 \2"))
        per_text = pc.list_value_length(words).to_numpy()
        coded = words.flatten().dictionary_encode()
        values = self._ids_of(coded.dictionary.to_pylist())
        n = np.fromiter(map(len, values), np.int32, len(values)) // 4
        pool, first = np.frombuffer(b"".join(values), "<u4"), np.cumsum(n, dtype=np.int32) - n
        which = coded.indices.to_numpy()
        sizes = n[which]
        ends = np.cumsum(sizes, dtype=np.int32)
        at = np.repeat(first[which] - ends + sizes, sizes)
        at += np.arange(len(at), dtype=np.int32)
        out = pool[at]
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield out[a:b]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        values = list(map(self.known.get, words))
        missing = [k for k, v in enumerate(values) if v is None]
        new = []
        for k in missing:
            values[k] = ids = self.older.get(words[k])
            if ids is None:
                new.append(words[k])
            else:
                self.known[words[k]] = ids
        self._learn(new)
        for k in missing:
            values[k] = self.known[words[k]]
        if len(self.known) > self.cache_words:
            self.older, self.known = self.known, {"": b""}
        return values

    def _learn(self, pieces: list[str]) -> None:
        """Words that are one run of letters whatever the tokenizer's normaliser does are encoded together, with
        spaces between them: each ends with the only id that ends a piece. Others are encoded alone."""
        sure, alone = [], []
        for p in pieces:
            letters = p.isalpha() and (p.isascii() or (is_normalized("NFC", p) and len(low := p.lower()) == len(p) and low.isalpha()))
            (sure if letters else alone).append(p)
        for k in range(0, len(sure), CALL_WORDS):
            some = sure[k:k + CALL_WORDS]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(some) or ends[-1] != 4 * len(ids):
                alone += some
                continue
            data, ends = ids.tobytes(), ends.tolist()
            self.known.update(zip(some, [data[a:b] for a, b in zip([0, *ends], ends)], strict=True))  # noqa: B905
        for p in alone:
            ids = self.tokenizer.encode(p, add_special_tokens=False).ids
            self.known[p] = np.array(ids, "<u4").tobytes()


def text_parts(data: bytes) -> Iterator[bytes]:
    """Slices of about SLICE bytes, cut behind white space."""
    at = 0
    while len(data) - at > SLICE:
        cut = max(data.rfind(b" ", at, at + SLICE), data.rfind(b"\n", at, at + SLICE))
        if cut < at:  # one long word: up to the next white space
            cut = min((k for c in b" \n\t\r\x0b\x0c" if (k := data.find(c, at)) >= 0), default=len(data))
        yield data[at:cut + 1]
        at = cut + 1
    yield data[at:] if at else data


_ENCODERS: dict[str, WordEncoder] = {}
M_MMAP_THRESHOLD = -3  # fixed value: glibc's option


def _return_large_buffers() -> None:
    """From now on freed buffers of over 1 MB go back to the system: two workers share an executor's memory with
    its JVM, and the C library and Arrow would keep what a batch needed for a moment."""
    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(M_MMAP_THRESHOLD, 1 << 20)


def worker_encoder(blob: bytes) -> WordEncoder:
    """The encoder of this Python worker: Spark reuses workers, so its cache serves later tasks as well."""
    key = hashlib.sha1(blob).hexdigest()
    if key not in _ENCODERS:
        _return_large_buffers()
        _ENCODERS[key] = WordEncoder(blob)
    return _ENCODERS[key]
