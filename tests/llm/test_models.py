"""Language and quality: exact marginals, held-out accuracy, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampflow.llm import crf, language, quality


@pytest.mark.parametrize("k", [2, 4])
def test_marginals_equal_the_textbook_recursion(k):
    rng = np.random.default_rng(k)
    lengths = [1, 3, 64, 65, 130, 7, 300]
    starts = np.cumsum([0, *lengths[:-1]])
    scores, trans = 3 * rng.normal(size=(sum(lengths), k)), rng.normal(size=(k, k))
    got, pairs = crf.forward_backward(scores, starts, trans, pairs=True)
    expected = np.zeros((k, k))
    for at, n in zip(starts, lengths):
        s = scores[at : at + n]
        a, b = s.copy(), np.zeros((n, k))
        for i in range(1, n):
            a[i] += np.logaddexp.reduce(a[i - 1][:, None] + trans, 0)
        for i in range(n - 2, -1, -1):
            b[i] = np.logaddexp.reduce(trans + s[i + 1] + b[i + 1], 1)
        z = np.logaddexp.reduce(a[-1])
        assert np.allclose(np.exp(a + b - z), got[at : at + n], atol=1e-8)
        for i in range(1, n):
            expected += np.exp(a[i - 1][:, None] + trans + s[i] + b[i] - z)
    assert np.allclose(expected, pairs, atol=1e-6)


def test_no_items():
    assert crf.forward_backward(np.zeros((0, 3)), np.zeros(0, int), np.zeros((3, 3))).shape == (0, 3)


def test_language_of_held_out_documents(docs, corpus):
    rows = language.identify(docs, F.col("doc_id") % 4 != 0).collect()
    assert len(rows) == len(corpus)
    truth = {r[0]: r[2] for r in corpus}
    got = {r.doc_id: r for r in rows}
    held = [i for i in range(0, 120, 4)]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.9
    for i in (200, 201, 202, 203):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[204].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows)


def test_code_switching_is_labelled_word_by_word():
    model = language.fit(["the river under water again " * 40, "der fluss und wasser wieder " * 40], ["en", "de"])
    names, sure, fit = language.label(model, ["the river under water again der und fluss", "der und wieder the"])
    assert names == ["en", "de"] and 0.5 < sure[0] < 0.95 and fit[0] > 0.9


def test_language_without_rows_or_labels(nothing, nulls):
    assert language.identify(nothing, F.lit(True)).count() == 0
    assert [(r.lang_pred, r.score) for r in language.identify(nulls, F.lit(True)).collect()] == [("und", 0.0)] * 2


def test_quality_of_held_out_documents(spark, docs, corpus):
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(120)] + [(None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.classify(docs, labels, F.col("doc_id") % 4 != 0).collect()}
    held = [i for i in range(0, 120, 4)]
    assert np.mean([rows[i].predicted == int(i % 5 != 0) for i in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_quality_without_rows_or_labels(spark, nothing, docs, nulls):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(nothing, none, F.lit(True)).count() == 0
    assert {(r.score, r.predicted) for r in quality.classify(docs.limit(3), none, F.lit(True)).collect()} == {(0.5, 1)}
    assert quality.classify(nulls, none, F.lit(True)).count() == 2


def test_samples_are_bounded_and_cover_repeated_ids(spark, monkeypatch):
    from ampflow.llm import common

    rows = spark.range(6000).selectExpr("id % 3000 doc_id", "cast(id % 3000 % 3 as int) kind").union(spark.range(20_000).selectExpr("5L", "2"))
    got = common.picked(rows, "kind", 40)
    assert sorted(r.kind for r in got) == [0] * 40 + [1] * 40 + [2] * 40 and len({r.doc_id for r in got}) == 120
    assert len(common.picked(rows, "kind", 5000)) == 3000
    docs = spark.createDataFrame([(1, "abc"), (1, "abd"), (2, "x" * 50), (3, None), (4, "yy")], "doc_id long, text string")
    assert common.texts_of(docs, [2, 1, 3, 4, 9], 10) == {1: "abc", 3: None, 4: "yy"}
    assert common.texts_of(docs, [], 10) == {} == common.texts_of(docs, [2], 10)
