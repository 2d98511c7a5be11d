import itertools

import numpy as np
from pyspark.sql import functions as F

from aislelens.llm import language

from . import cases

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = language.query(spark, SF).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_spans_of_mixed_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    one = {r.lang: " ".join(r.text.split()[:40]) for r in docs.limit(200).collect()}
    text = f"{one['en']} {one['fr']} Привет мир {one['de']}"
    (row,) = language.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [s.lang for s in row.spans] == ["en", "fr", "und", "de"]
    assert text[row.spans[2].start:row.spans[2].end] == "Привет мир"
    assert abs(row.spans[1].start - len(one["en"]) - 1) < 12


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    lengths = np.array([4, 0, 6, 1, 5])
    scores = rng.normal(size=(lengths.sum(), 3)) * 3
    got = language.viterbi(scores, lengths, 2.0)
    at = 0
    for n in lengths:
        part = scores[at:at + n]

        def value(path):
            return sum(part[k, p] for k, p in enumerate(path)) - 2.0 * sum(a != b for a, b in itertools.pairwise(path))

        if n:
            best = max(itertools.product(range(3), repeat=int(n)), key=value)
            assert value(tuple(got[at:at + n])) == value(best)
        at += n


def test_keeps_texts_in_many_languages(spark):
    """Seven languages of similar shares: none has a fifth of the letters, all letters are in learnt spans."""
    signs = ["abcdef", "αβγδεζ", "абвгде", "աբգդեզ", "אבגדהו", "ابتثجح", "กขคงจฉ"]
    words = [" ".join(s[k % 5] + s[k % 4] + s[k % 3] for k in range(30)) for s in signs]
    rows = [(100 * k + j, w, f"l{k}") for k, w in enumerate(words) for j in range(9)]
    rows += [(9000, " ".join(words), None), (9001, "1234 !!", None), (9002, "あいう" * 40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    (mixed,) = language.identify(docs.filter("doc_id = 9000"), language._learnt(docs)).collect()
    assert 0 < mixed.score < language.LEAST_SCORE
    assert {r.doc_id for r in language.keep_known(docs).collect()} == {r[0] for r in rows} - {9001, 9002}
    blank = docs.withColumn("lang", F.lit(None).cast("string"))  # nothing is learnt
    assert {r.doc_id for r in language.keep_known(blank).collect()} == {r[0] for r in rows} - {9001}


def test_odd_rows(spark):
    docs = cases.frame(spark)
    model = language.fit(docs)
    rows = language.identify(docs, model).collect()
    assert len(rows) == len(cases.rows())
    by = {r.doc_id: r for r in rows}
    assert {by[k].lang_pred for k in (5, 6, 7, 14)} == {"und"} and by[5].score == 0
    assert by[1].lang_pred == "en" and by[11].lang_pred in ("en", "de") and by[9].lang_pred == "de"
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns
    assert not {5, 6, 7, 14} & {r.doc_id for r in kept.collect()}


def test_nothing_learnt(spark):
    assert language.fit(cases.empty(spark)).langs == []
    rows = language.identify(cases.frame(spark), language.fit(cases.empty(spark))).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    assert language.identify(cases.empty(spark), language.fit(cases.frame(spark))).count() == 0
    assert language.keep_known(cases.empty(spark)).count() == 0
