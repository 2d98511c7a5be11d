import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from aislelens.llm import simhash

from . import cases

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(text):
    """The fingerprint, bit by bit."""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbBé \n\t\x1c.", max_size=60), max_size=6))
def test_fingerprint_is_the_plain_one(texts):
    got = simhash.majority([simhash._hashes(t, 4) for t in texts])
    assert got.tolist() == [plain(t) for t in texts]


def test_long_text_in_slices():
    text = cases.prose(9, 1500) * 200
    assert len(text) > 1 << 20
    words = text.split()
    assert len(simhash._hashes(text, 4)) == len(words) - 3
    assert int(simhash.majority([simhash._hashes(text, 4)])[0]) == plain(text)


def test_tiles_lose_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3000, np.uint64)
    flips = base[:900].copy()
    for k in range(4):
        flips ^= np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)
    fps = np.unique(np.concatenate([base, flips, base[:1] ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))]))
    half = rng.random(len(fps)) < 0.5
    up = {int(f): int(f) for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for left, right in ((fps[half], None), (fps[~half], None), (fps[half], fps[~half])):
        a, b = simhash.linked(left, right, 4)
        assert (np.bitwise_count(a ^ b) >= 1).all()
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = root(x), root(y)
            up[max(x, y)] = min(x, y)
    got = np.array([root(int(f)) for f in fps])
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    label = np.arange(len(fps))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    assert len(set(zip(got.tolist(), label.tolist()))) == len(set(got.tolist())) == len(set(label.tolist()))


def test_components_and_near_dedup(spark):
    docs = cases.frame(spark)
    rows = docs.select("doc_id", "text").rdd.zipWithIndex().map(lambda x: (x[1], *x[0])).toDF("rid long, doc_id long, text string")
    got = simhash.grouped(simhash.fingerprints(rows)).collect()
    fps = {}
    for r in cases.rows():
        fps.setdefault(plain(r[1]), []).append(r[0])
    label = {f: f for f in fps}
    for _ in fps:
        for f in fps:
            for g in fps:
                if (f ^ g).bit_count() <= 4:
                    label[f] = label[g] = min(label[f], label[g])
    least = {}
    for f, ids in fps.items():
        least.setdefault(label[f], []).extend(i for i in ids if i is not None)
    assert len(got) == len(cases.rows())
    for r in got:
        ids = least[label[r.fp % (1 << 64)]]
        assert r.component_id == (min(ids) if ids else None)
    kept = simhash.near_dedup(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(min(v) for v in least.values() if v)
    assert kept[0].__fields__ == docs.columns
    assert simhash.near_dedup(cases.empty(spark)).count() == 0
