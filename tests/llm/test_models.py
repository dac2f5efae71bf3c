"""Language codes and quality scores on held-out documents."""

import numpy as np
import pytest

from debtscope.llm.language_id import LanguageCode, codewords, identify, learn_languages
from debtscope.llm.quality_model import QualityNet, form_rows, learn_quality, score_quality, word_contexts, word_vectors
from debtscope.llm.queries import held_out, op7_quality_scores, op8_language_id
from debtscope.session import table

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n,apart", [(2, 1), (3, 2), (4, 4), (5, 8), (7, 32), (8, 8), (9, 8), (40, 32)])
def test_codewords_are_far_apart(n, apart):
    code = codewords(n)
    columns = {tuple(c * c[0]) for c in code.T}
    assert len(columns) == code.shape[1] and all(len(set(c)) == 2 for c in code.T)
    assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= apart
    # Fewer wrong bits than half of that distance leave the nearest word what it was.
    rng = np.random.default_rng(n)
    for i in range(n):
        said = code[i].copy()
        said[rng.choice(len(said), (apart - 1) // 2, replace=False)] *= -1
        assert (code != said).sum(axis=1).argmin() == i


def test_codes_of_no_and_one_class():
    assert codewords(0).shape[0] == 0
    assert LanguageCode([], np.zeros((0, 8192))).decide(b"abc") == ("und", 0.0, False)
    assert LanguageCode(["en"], np.ones((1, 8192))).decide(b"abc") == ("en", 1.0, False)


def test_languages_held_out(spark):
    lang = {r.doc_id: r.lang for r in table(spark, FOLDER, "documents").select("doc_id", "lang").collect()}
    rows = op8_language_id(spark, FOLDER).collect()
    aside = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and aside and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in aside) >= 0.98 * len(aside)


def test_texts_without_letters(spark, make):
    docs = make([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "x", None)], "doc_id long, text string, lang string")
    model = learn_languages(docs)
    odd = make([(1, None), (2, ""), (3, "12 !?"), (4, "日本"), (5, "the dog")])
    got = {r.doc_id: r for r in identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred in ("en", "fr") and got[5].lang_pred == "en"
    assert identify(make([]), model).count() == 0 and learn_languages(make([], "doc_id long, text string, lang string")).names == []


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    rows = op7_quality_scores(spark, FOLDER).collect()
    assert len(rows) == table(spark, FOLDER, "documents").count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    aside = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in aside if y], [s for s, y in aside if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_sees_only_the_labels_given(spark):
    docs = table(spark, FOLDER, "documents").select("doc_id", "text")
    labels = table(spark, FOLDER, "labels")
    vectors = word_vectors(word_contexts(docs))
    flipped = labels.withColumn("quality", labels.quality + held_out().cast("int") * (1 - 2 * labels.quality))
    a, b = (learn_quality(docs, x.where(~held_out()), vectors) for x in (labels, flipped))
    x = np.random.default_rng(1).normal(size=(50, vectors.shape[1]))
    assert (a.scores(x) == b.scores(x)).all()


def test_quality_without_labels_or_texts(spark, make):
    docs = make([(1, None), (2, ""), (3, "a b")])
    vectors = word_vectors(word_contexts(docs))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in score_quality(docs, vectors, learn_quality(docs, none, vectors)).collect()] == [0.5] * 3
    one = spark.createDataFrame([(3, 1), (3, 1), (4, None)], "doc_id long, quality int")
    assert learn_quality(docs, one, vectors).constant == 1.0
    assert score_quality(make([]), vectors, QualityNet(np.zeros((0, 64)), np.zeros(0))).count() == 0
    assert word_contexts(make([])).shape == vectors.shape


def test_rows_of_word_forms():
    assert form_rows(["The", "the"])[0] == form_rows(["x", "the"])[1]
    assert form_rows(["aa!!"])[0] == form_rows(["bcd!!!"])[0] != form_rows(["aa"])[0]
    assert form_rows(["ab", "ab", "ab"])[1] == form_rows(["cd", "cd"])[1]


def test_temperature_calibrates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 8))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = QualityNet(x, y).scores(x)
    for low in (0.1, 0.4, 0.7):
        band = (p >= low) & (p < low + 0.2)
        assert abs(y[band].mean() - p[band].mean()) < 0.08
