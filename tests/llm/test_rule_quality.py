"""The rule ensemble: held-out accuracy, rules as columns, edge rows."""

from __future__ import annotations

import math
import os

import pytest
from pyspark.sql import functions as F

from salesloom.llm import queries, rule_quality as rq
from salesloom.llm.common import fold_of, table

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, stats string, score string, label string"


@pytest.fixture(scope="module")
def scored(spark):
    return queries.op5_rule_quality(spark, SF).cache()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not available")
def test_held_out_rows_are_told_apart(spark, scored):
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    assert scored.count() == table(spark, SF, "documents").count()
    held = scored.filter("held_out").join(table(spark, SF, "labels"), "doc_id")
    assert held.filter("predicted = quality").count() >= 0.95 * held.count()
    assert scored.filter("score < 0 OR score > 1 OR predicted != cast(score >= 0.5 as int)").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not available")
def test_labels_of_the_held_out_fold_change_nothing(spark, scored):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    held = fold_of("doc_id", 3) == 1
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    model = rq.fit_from_labels(docs, flipped, ~held)
    again = rq.rule_quality(docs, model).select("doc_id", F.col("score").alias("s"))
    assert scored.join(again, "doc_id").filter("abs(s - score) > 1e-9").count() == 0


def test_a_rule_is_a_column(spark):
    model = rq.RuleModel(-1.0, (rq.Rule(((0, True, 2.0), (1, False, 0.5)), 3.0), rq.Rule(((1, True, 0.5),), -2.0)))
    rows = spark.createDataFrame([([3.0, 0.1],), ([3.0, 0.9],), ([2.0, 0.5],)], "stats array<double>")
    got = [r[0] for r in rows.select(model.score(F.col("stats"))).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-z)) for z in (2.0, -3.0, -1.0)])


def test_statistics_of_plain_cases():
    named = lambda t: dict(zip(rq.STATISTICS, rq.text_statistics(t)))
    assert set(rq.text_statistics("")) == {0.0}
    s = named("AB cd\n!|")
    assert (s["upper"], s["lower"], s["bang"], s["pipe"], s["newline"], s["space"]) == (2 / 8, 2 / 8, 1 / 8, 1 / 8, 1 / 8, 1 / 8)
    assert named("a a a b")["top_word"] == 0.75
    assert all(math.isfinite(x) for t in (" ", "\n", "\x00", "é" * 90_000, "| " * 9) for x in rq.text_statistics(t))


def test_fit_without_labels_or_with_one_label(spark):
    docs = spark.createDataFrame([(1, "a b", "", "", ""), (2, None, "", "", "")], SCHEMA)
    none = spark.createDataFrame([(None, 1), (2, None)], "doc_id long, quality int")
    assert rq.fit_from_labels(docs, none, F.lit(True)) == rq.RuleModel(0.0, ())
    one = spark.createDataFrame([(1, 1), (2, 1), (2, 0)], "doc_id long, quality int")
    model = rq.fit_from_labels(docs, one, F.lit(True))
    assert model.rules == () and model.intercept == pytest.approx(math.log(3))


def test_rows_with_nulls_repeats_and_clashing_names(spark):
    rows = [(None, "Some text.", "x", "y", "z"), (1, None, None, None, None), (1, "", "", "", ""), (1, "", "", "", ""), (4, "w " * 50_000, "", "", "")]
    model = rq.RuleModel(0.3, (rq.Rule(((0, True, 1.0),), 0.5),))
    got = rq.rule_quality(spark.createDataFrame(rows, SCHEMA), model)
    assert got.columns == ["doc_id", "score", "predicted"]
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "1", "1", "4", "None"]
    assert rq.rule_quality(spark.createDataFrame([], SCHEMA), model).count() == 0
