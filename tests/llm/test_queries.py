"""Registered queries against their SQL texts, and the pipeline against plain loops."""

from __future__ import annotations

import hashlib
import os
import re

import duckdb
import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from salesloom.llm import queries, rule_quality
from salesloom.llm.common import fold_of
from tests.llm import test_decontaminate, test_exact_dedup, test_near_dup
from tools.check_oracle import _rows

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not available")


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(entry.oracle_sql())
    assert [n for n, _ in cp.STAGES] and cp.ORACLE_SQL is None and len(cp.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    cur = con.execute(queries.ORACLES[name])
    columns, rows = [c[0] for c in cur.description], cur.fetchall()
    df = queries.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, rows)


@pytest.fixture(scope="module")
def documents(spark):
    """The small table with hard rows added."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = docs.orderBy("doc_id").first().text
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text
    more = [
        (900_001, text, "en", "x", 0), (900_001, text, "en", "x", 0), (900_002, text + " \n", None, None, None), (900_003, f"{text} {item} {text[::-1]}", "en", "x", 1),
        (900_004, None, None, None, None), (900_005, "", "en", "", 0), (None, "a text of its own without an id, " + text[::-1], "en", "x", 2),
        (900_006, "word " * 40_000, "en", "x", 2), (900_007, text.replace("the", "teh", 1), "en", "x", 3),
    ]
    return docs.select(*cp.COLUMNS).unionByName(spark.createDataFrame(more, docs.select(*cp.COLUMNS).schema)).withColumn("_rule_extra", F.lit(1))


def taken(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_pipeline_stage_by_stage(spark, documents):
    # 1: what the classifier accepts
    one = cp.stored(cp.quality(spark, documents, SMALL), "test")
    assert one.columns == cp.COLUMNS
    model = rule_quality.fit_from_labels(documents, spark.read.parquet(f"{SMALL}/labels.parquet"), fold_of("doc_id", 3) != 1)
    scores = rule_quality.rule_quality(documents, model).collect()
    assert sorted(str(r.doc_id) for r in scores if r.predicted == 1) == sorted(str(r.doc_id) for r in one.collect())

    # 2: one row of each group of equal texts
    two = cp.stored(cp.exact(spark, one, SMALL), "test")
    assert two.columns == cp.COLUMNS
    rows = [(r.doc_id, r.text) for r in one.collect()]
    stays = {(i, t) for (i, t), (_, _, _, kept) in zip(sorted(rows, key=str), _aligned(rows)) if kept}
    assert taken(two.select("doc_id", "text")) == sorted(stays, key=str)

    # 3: the smallest id of each class
    three = cp.stored(cp.near(spark, two, SMALL), "test")
    assert three.columns == cp.COLUMNS
    rows = [(r.doc_id, r.text) for r in two.collect()]
    classes = dict(test_near_dup.brute(rows))
    assert taken(three.select("doc_id")) == sorted(((i,) for i, _ in rows if i is None or classes[i] == i), key=str)

    # 4: no benchmark item
    four = cp.stored(cp.decontaminated(spark, three, SMALL), "test")
    assert four.columns == cp.COLUMNS
    rows = [(r.doc_id, r.text) for r in three.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    found = {d for d, *_ in test_decontaminate.brute(rows, items)}
    assert taken(four.select("doc_id")) == sorted(((i,) for i, _ in rows if i not in found), key=str)

    # 5: encoded and decoded
    five = cp.encoded(spark, four, SMALL)
    library = tokenizers.Tokenizer.from_file(cp.TOKENIZER)
    expected = []
    for r in four.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        expected.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert taken(five) == sorted(expected, key=str)


def _aligned(rows):
    """The brute-force decisions, in the order of the rows sorted as text."""
    return [test_exact_dedup.brute_row(rows, i, t) for i, t in sorted(rows, key=str)]


def test_pipeline_on_an_empty_table(spark, documents):
    docs = documents.limit(0).select(*cp.COLUMNS)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, SMALL), "test")
    assert taken(docs) == taken(cp.run(spark, SMALL))


@pytest.fixture(scope="module")
def keyless(spark):
    """(item, rows): many rows without an id, and one id with many texts."""
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None if k < 4 else 7 if k < 8 else k, own(k), "en", "x", k) for k in range(10)]
    return item, own, rows, spark.read.parquet(f"{SMALL}/documents.parquet").select(*cp.COLUMNS).schema


def test_decontaminated_decides_by_row(spark, keyless):
    item, own, rows, schema = keyless
    dirty = [(None, f"{own(20)} {item} {own(21)}", "en", "x", 20), (7, f"{own(22)} {item}", "en", "x", 22), (30, item, "en", "x", 30)]
    got = cp.decontaminated(spark, spark.createDataFrame(rows + dirty + [(None, None, None, None, None)], schema), SMALL)
    assert got.columns == cp.COLUMNS
    assert taken(got) == sorted([*rows, (None, None, None, None, None)], key=str)


def test_near_decides_by_row(spark, keyless):
    _, own, rows, schema = keyless
    copies = [
        (7, own(9) + " end", "en", "x", 40), (3, own(8) + " end", "en", "x", 41), (7, own(5) + " end", "en", "x", 42), (None, own(9) + " other", "en", "x", 43),
    ]
    got = taken(cp.near(spark, spark.createDataFrame(rows + copies, schema), SMALL).select("doc_id", "n_chars"))
    # 8 is a near copy of the new 3, 9 of a row of 7; of the two rows of 7 that are near copies one stays
    assert sorted(n for _, n in got if n not in (5, 42)) == [0, 1, 2, 3, 4, 6, 7, 40, 41, 43]
    assert len([n for _, n in got if n in (5, 42)]) == 1


def test_near_with_unique_ids_and_repeated_nulls(spark, keyless):
    _, own, rows, schema = keyless
    unique = [(None if i is None else n, *rest, n) for i, *rest, n in rows]
    got = cp.near(spark, spark.createDataFrame([*unique, (50, own(9) + " end", "en", "x", 50)], schema), SMALL)
    assert taken(got) == sorted(unique, key=str)
