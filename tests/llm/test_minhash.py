import hashlib

import numpy as np

from aislelens.llm import minhash

from . import cases


def shingles(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits(spark):
    rows = [r[:2] for r in cases.rows()]
    got = minhash.edits(cases.frame(spark), part_bytes=20_000).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    assert len(got) == len(rows)
    want = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        changed = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        want.setdefault((i, len(t), hashlib.sha256(changed.encode()).hexdigest()), []).append(
            (jaccard(shingles(t), shingles(changed)), jaccard(shingles(t), shingles(nxt))))
    for r in got:
        edit, near = want[(r.doc_id, r.n_chars, r.edited_sha256)].pop()
        assert abs(r.near_edited - edit) < 0.2 and abs(r.near_next - near) < 0.2
        parts = [[x[k:k + 4] for k in range(0, len(x), 4)] for x in (r.fingerprint, r.edited_fingerprint)]
        assert r.near_edited == np.mean([a == b for a, b in zip(*parts)])


def test_equal_texts_and_slices():
    long = cases.prose(5, 4000)
    minhash.SLICE, whole = 10_000, minhash.fingerprints([long, long + " x", "", "a b", long])
    try:
        cut = minhash.fingerprints([long, long + " x", "", "a b", long])
    finally:
        minhash.SLICE = 8 << 20
    assert (whole == cut).all() and (whole[0] == whole[4]).all()
    assert (whole[0] == whole[1]).mean() > 0.9 and not (whole[2] == whole[3]).any()


def test_near_duplicates(spark):
    base = cases.prose(7, 200).split()
    rows = list(enumerate([r[1] for r in cases.rows()]))
    for k in range(40):  # a chain of near copies, and copies of one text
        words = list(base)
        words[3 * k % 190] = f"w{k}"
        rows += [(100 + k, " ".join(words)), (200 + k, " ".join(base))]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for _ in range(3):
        for i in sets:
            for j in sets:
                if jaccard(sets[i], sets[j]) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
    assert got == label


def test_empty(spark):
    assert minhash.edits(cases.empty(spark)).count() == 0
    assert minhash.near_duplicates(cases.empty(spark)).count() == 0


def test_recall_of_pairs_near_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.9, by exact Jaccard: all are linked, and none below."""
    import random

    rng = random.Random(7)
    rows, pairs = [], []
    for k in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        other = list(words)
        for at in rng.sample(range(300), rng.randint(3, 9)):
            other[at] = f"x{k}-{at}"
        a, b = ({tuple(x[i:i + 5]) for i in range(296)} for x in (words, other))
        pairs.append(len(a & b) / len(a | b) >= 0.8)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[2 * k + 1] == 2 * k for k in range(150)] == pairs and 20 < sum(pairs) < 130
