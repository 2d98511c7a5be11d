import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from aislelens.llm import packing, token_files
from aislelens.llm.token_ids import WordEncoder
from aislelens.session import scratch_path

from . import cases

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "å b", "J̌ x İstanbul ΣΑΣ.", "<|endoftext|>", "x<|endoftext|>y", "don't it's 's.", "क् कि.",
       "ﬁ ǅ ß ẞ", " a b\x1cc", "a.b,c!! 12.5% (foo)", "Ⅳ ² ½", "é. É! É", "“quote” —", "a\x00b", "ŉ. İ. K K", "ǰ J̌."]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_words_give_the_ids_of_whole_texts(tokenizer):
    rng = random.Random(1)
    signs = "aAbBéÉ \n.,'!|<>3́̌ßİΣ가\U0001F600-  "
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    with open(PATH, "rb") as f:
        encoder = WordEncoder(f.read(), cache_words=500)
    for _ in range(2):
        got = list(encoder.encode(pa.array(texts)))
        assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def expected(tokenizer):
    return [(r[0], np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")) for r in cases.rows()]


def test_packing_round_trip(spark, tokenizer):
    pieces, sequences = packing.pack(cases.frame(spark))
    by_sequence = {r.sequence_id: r for r in sequences.collect()}
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert all(len(r.ids) == 4 * 2048 for r in by_sequence.values())
    assert all(by_sequence[k].n_tokens == 2048 for k in list(by_sequence)[:-1] if k != max(by_sequence))
    stream = b"".join(by_sequence[k].ids for k in sorted(by_sequence))
    total = sum(len(x) for _, x in expected(tokenizer))
    assert sum(r.n_tokens for r in by_sequence.values()) == total
    seen = np.zeros(total, int)
    docs = {}
    for p in pieces.collect():
        at = p.sequence_id * 2048 + p.offset
        seen[at:at + p.length] += 1
        assert stream[4 * at:4 * (at + p.length)] == bytes(p.ids)
        docs.setdefault((at - p.start, p.doc_id, p.doc_tokens), []).append((p.start, bytes(p.ids)))
    assert (seen == 1).all()
    got = [(k[1], b"".join(x for _, x in sorted(v))) for k, v in docs.items()]
    assert sorted(map(cases.key, got)) == sorted(map(cases.key, [(i, x.tobytes()) for i, x in expected(tokenizer)]))


def test_token_files_round_trip(spark, tokenizer):
    folder = scratch_path(spark, "tokens")
    manifest = token_files.write(cases.frame(spark), folder, shard_bytes=100_000)
    rows = sorted(token_files.read(manifest).collect(), key=lambda r: r.start)
    texts = sorted(cases.rows(), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))  # null first
    want = [(r[0], np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")) for r in texts]
    assert [r.doc_id for r in rows] == [x[0] for x in want]
    assert [r.start for r in rows] == (np.cumsum([len(x[1]) for x in want]) - [len(x[1]) for x in want]).tolist()
    got = sorted((cases.key((r.doc_id,)), zlib.crc32(r.ids)) for r in rows)
    assert got == sorted((cases.key((i,)), zlib.crc32(x.tobytes())) for i, x in want)
    shards = [token_files.Shard(r.path) for r in manifest.collect()]
    assert len(shards) > 1
    found = [s.get(9) for s in shards]
    assert [x.tolist() for x in found if x is not None] == [[*tokenizer.encode("Zwei Wörter.", add_special_tokens=False).ids, 1]]
    assert sum(s.get(12, 2) is not None for s in shards) == 1 and all(s.get(12, 3) is None and s.get(999) is None for s in shards)
    assert sum(s.get(None, 1) is not None for s in shards) == 1


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 50_000))
    zero = np.zeros(len(keys), np.uint32)
    hashed = token_files.PerfectHash.build(keys, zero)
    assert sorted(hashed.slots(keys, zero).tolist()) == list(range(len(keys)))


def test_empty(spark):
    pieces, sequences = packing.pack(cases.empty(spark))
    assert pieces.count() == 0 and sequences.count() == 0
    assert token_files.read(token_files.write(cases.empty(spark), scratch_path(spark, "tokens"))).count() == 0
