"""Language identification: held-out accuracy, backoff, edge rows."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesloom.llm import lang_id, queries
from salesloom.llm.common import table

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not available")
def test_held_out_rows_are_told_apart(spark):
    got = queries.op8_lang_id(spark, SF).cache()
    docs = table(spark, SF, "documents")
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert got.count() == docs.count()
    held = got.filter("held_out").join(docs, "doc_id").filter("lang_pred != 'und'")
    assert held.filter("lang_pred = lang").count() >= 0.95 * held.count()
    assert got.filter("score < 0 OR score > 1").count() == 0


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, "the cat and the hat", "en", "", "") for i in range(5)] + [(9 + i, "Der Hund und das Haus", "de", "", "") for i in range(5)]
    rows += [(50, "xyzxyz " * 9, None, "", ""), (51, None, "fr", "", ""), (52, "le chat " * 9, "fr", "", "")]
    return lang_id.fit_languages(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") != 52)


def test_only_named_rows_of_the_fold_are_learned(model):
    assert model.languages == ["de", "en"]
    assert set(model.words) == {"the", "cat", "and", "hat", "der", "hund", "und", "das", "haus"}
    assert "xyz" not in model.grams and "chat" not in model.grams


def test_backoff_takes_the_longest_known_piece(model):
    word = "hauscat"  # not a known word
    marked = f"<{word}>"
    expected = np.zeros(2)
    for end in range(2, len(marked) + 1):
        for n in (4, 3, 2, 1):
            if n <= end and marked[end - n : end] in model.grams:
                expected += model.gram_logs[model.grams[marked[end - n : end]]]
                break
    assert np.allclose(model.of_word(word), expected)
    assert np.array_equal(model.of_word("cat"), model.word_logs[model.words["cat"]])
    assert {len(g) for g in model.grams} == {1, 2, 3, 4}
    assert "<" in model.grams and ">" in model.grams


def test_rows_with_nulls_ties_and_clashing_names(spark, model):
    rows = [
        (1, None, None, "x", "y"), (None, "", "en", None, None), (2, "12 345 !! ...", "", "", ""), (3, "THE HAT!!", None, "", ""),
        (3, "THE HAT!!", None, "", ""), (4, "und " * 60_000, None, "", ""),
    ]
    got = lang_id.identify(spark.createDataFrame(rows, SCHEMA), model)
    assert got.columns == ["doc_id", "lang_pred", "score"]
    found = sorted(((r.doc_id, r.lang_pred) for r in got.collect()), key=str)
    assert found == sorted([(1, "und"), (None, "und"), (2, "und"), (3, "en"), (3, "en"), (4, "de")], key=str)
    assert lang_id.identify(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_equal_sums_go_to_the_first_language():
    even = lang_id.LanguageModel(["de", "en"], {"a": 0}, np.zeros((1, 2)), {}, np.zeros((0, 2)))
    assert lang_id._Scorer(even).predict(["a", "unseen"]) == [("de", 0.5), ("de", 0.5)]


def test_nothing_to_learn_from(spark):
    model = lang_id.fit_languages(spark.createDataFrame([], SCHEMA), F.lit(True))
    rows = spark.createDataFrame([(1, "hello", None, None, None)], SCHEMA)
    assert [tuple(r) for r in lang_id.identify(rows, model).collect()] == [(1, "und", 0.0)]


def test_a_full_word_table_changes_nothing(monkeypatch, model):
    texts = ["the cat und hund", "das haus the", "cattle hausen"] * 3
    expected = [lang_id._Scorer(model).predict([t])[0] for t in texts]
    monkeypatch.setattr(lang_id, "MAX_WORDS", 1)
    scorer = lang_id._Scorer(model)
    assert [scorer.predict([t])[0] for t in texts] == expected
