"""Progressive refinement against grouping by the normalised text."""

from __future__ import annotations

import random
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from salesloom.llm import common, exact_dedup as ed

SCHEMA = "doc_id long, text string, keep_id string, kept string, _len string"


def normalised(text):
    return "".join(c for c in (text or "") if c not in common.WHITE)


def brute(rows):
    return sorted((brute_row(rows, i, t) for i, t, *_ in rows), key=str)


def brute_row(rows, i, t):
    """The decision on one row: id, id that stays, rows of the group, whether it stays."""
    group = _groups(tuple((j, u) for j, u, *_ in rows))[normalised(t)]
    best = min(group, key=lambda x: (x[0], x[1], x[2] or 0))
    return i, best[2], len(group), i == best[2] and -len(t or "") == best[0]


@lru_cache(maxsize=2)
def _groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normalised(t)].append((-len(t or ""), i is None, i))
    return groups


def check(spark, rows, **kw):
    got = ed.exact_dedup(spark.createDataFrame(rows, SCHEMA), **kw)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_random_texts_with_shared_lengths_and_prefixes(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        t = "p" * 60 * r.randint(0, 1) + "".join(r.choice("abé \n\t ") for _ in range(r.randint(0, 4)))
        rows.append((i, t, None, None, None))
    check(spark, rows)
    check(spark, rows, prefix_chars=1)


def test_nulls_ties_repeats_and_long_texts(spark):
    long = "word " * 60_000
    check(spark, [
        (1, None, "", "", ""), (2, "", None, None, None), (3, " \n\t\x0b\x0c\r ", "", "", ""), (None, "x y", "", "", ""), (None, "x y", "", "", ""),
        (7, "xy", "", "", ""), (8, "x y", "", "", ""), (8, "x y", "", "", ""), (9, long, "", "", ""), (4, long + " ", "", "", ""), (5, long[:-5], "", "", ""),
        (11, None, "", "", ""), (12, "x y", "", "", ""),
    ])


def test_empty_table_and_carried_columns(spark):
    assert ed.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a", "k", None, None), (2, "a ", "z", None, None), (3, "b", None, None, None)]
    got = ed.exact_dedup(spark.createDataFrame(rows, SCHEMA), carry=[F.col("keep_id").alias("extra")])
    assert {(r.doc_id, r.keep_id, r.extra) for r in got.collect()} == {(1, 2, "k"), (2, 2, "z"), (3, 3, None)}


@pytest.mark.parametrize("bound", [0, 100_000])
def test_with_and_without_broadcast(spark, monkeypatch, bound):
    monkeypatch.setattr(ed, "maybe_broadcast", lambda df, n: common.maybe_broadcast(df, n, bound))
    check(spark, [(i, "same" if i % 3 else f"own {i}", None, None, None) for i in range(60)])


def test_no_python_in_the_plan(spark):
    df = ed.exact_dedup(spark.createDataFrame([(1, "a", "", "", "")], SCHEMA))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_each_level_prunes_and_a_digest_changes_nothing(spark):
    import hashlib

    pre = "p" * 60
    rows = [(1, pre + "a", None, None, None), (2, pre + "a ", None, None, None), (3, pre + "b", None, None, None), (4, "q" * 61, None, None, None), (5, pre + "abc", None, None, None), (6, "", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    base = docs.select(F.length(ed.normalised()).cast("long").alias("_len"), F.xxhash64(F.substring(ed.normalised(), 1, 48)).alias("_pre"))
    lengths = ed.repeated_lengths(base)
    assert [r[0] for r in lengths.collect()] == [61]  # of the lengths 61, 63 and 0
    assert ed.repeated_prefixes(base, lengths).count() == 1  # the row of q goes no further
    got = ed.exact_dedup(docs, digest="sum")
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "sum"]
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == brute(rows)
    assert {r.doc_id: r["sum"] for r in got.collect()} == {i: hashlib.sha256(normalised(t).encode()).hexdigest() for i, t, *_ in rows}
