"""Containment search against all pairs by a loop."""

from __future__ import annotations

import random
import re
from fractions import Fraction

import pytest

from salesloom.llm import common, decontaminate as dc

DOCS = "doc_id long, text string, item_id string, _hashes string, containment string"
ITEMS = "item_id long, text string, doc_id string"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def shingles(ws, n):
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()


def brute(docs, items, threshold="0.8"):
    best = {}
    for d, t, *_ in docs:
        have_words = words(t)
        have_of = {n: shingles(have_words, n) for n in range(6)}
        for i, q, *_ in items:
            n = min(5, len(words(q)))
            have, want = have_of[n], shingles(words(q), n)
            if want and len(have & want) >= Fraction(threshold) * len(want):
                key = (d, i)
                best[key] = max(best.get(key, (0,)), (len(have & want) / len(want), len(want), len(have & want)))
    return sorted(((d, i, n, s, c) for (d, i), (c, n, s) in best.items()), key=str)


def run(spark, docs, items, **kw):
    got = dc.contained_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **kw)
    assert got.columns == ["doc_id", "item_id", "item_shingles", "shared", "containment"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.fixture(scope="module")
def planted():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(r.choice([5, 6, 9, 20, 37, 60, 90]))), None) for i in range(30)]
    docs = []
    for d in range(120):
        ws = [word() for _ in range(r.choice([0, 3, 30, 300, 2500]))]
        for _ in range(r.randint(0, 2)):
            q = r.choice(items)[1].split()
            kind = r.random()
            q = q if kind < 0.5 else q[: int(len(q) * r.uniform(0.5, 1))] if kind < 0.8 else [w.upper() for w in q]
            at = r.randint(0, len(ws))
            ws[at:at] = q
        docs.append((d, r.choice([" ", "\n", "  \t"]).join(ws), None, None, None))
    return docs, items


def test_finds_what_all_pairs_find(spark, planted):
    docs, items = planted
    expected = brute(docs, items)
    assert len(expected) > 40 and run(spark, docs, items) == expected


def test_joins_without_broadcast_give_the_same(spark, planted, monkeypatch):
    docs, items = planted
    monkeypatch.setattr(dc, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(dc, "maybe_broadcast", lambda df, n: common.maybe_broadcast(df, n, 0))
    assert run(spark, docs, items) == brute(docs, items)


def test_nulls_short_texts_repeats_and_clashing_names(spark):
    q = "one two three four five six seven"
    docs = [(1, None, "", "", ""), (2, "", None, None, None), (None, f"x {q}", "", "", ""), (3, q, "", "", ""), (3, q, "", "", ""), (3, "other words", "", "", ""), (4, f"{'w ' * 50_000}{q}", "", "", "")]
    items = [(7, q, "d"), (7, q, "d"), (8, None, None), (9, "too short here", ""), (None, q, ""), (10, "a a a a a a a a", "")]
    assert run(spark, docs, items) == brute(docs, items)


def test_items_of_one_to_four_words(spark):
    items = [(1, "Alpha", ""), (2, "beta  gamma", ""), (3, "a b c d", ""), (4, "one two three four five", ""), (5, "zeta eta theta", ""), (6, "Alpha", ""), (7, " ", "")]
    docs = [(1, "alpha", "", "", ""), (2, "x BETA\ngamma y", "", "", ""), (3, "gamma beta", "", "", ""), (4, "a b c d e", "", "", ""), (5, "a b c x d", "", "", ""), (6, "zeta eta", "", "", ""), (7, "w " * 30_000 + "alpha one two three four five", "", "", ""), (8, "alphabet", "", "", "")]
    got = run(spark, docs, items)
    assert got == brute(docs, items) and {(d, i) for d, i, *_ in got} == {(1, 1), (1, 6), (2, 2), (4, 3), (7, 1), (7, 6), (7, 4)}


def test_rows_of_one_id_are_verified_one_by_one(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(None if k % 2 else 5, f"w{k} " * 20, "", "", "") for k in range(40)] + [(5, f"x {item} y", "", "", ""), (None, item, "", "", "")]
    items = [(1, item, ""), (2, "nothing of the kind is in any of them", "")]
    assert run(spark, docs, items) == brute(docs, items) and len(brute(docs, items)) == 2


def test_empty_tables(spark, planted):
    docs, items = planted
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_sketches_are_large_enough():
    for q in (1, 2, 16, 64, 1024):
        k = dc.sketch_size(q)
        least = max(1, q // 2)
        s = dc.THRESHOLD * least / (2 * q + (1 - dc.THRESHOLD) * least)
        assert k == 2 * q or (1 - s) ** k <= dc.MISS


def test_no_python_in_the_plan(spark, planted):
    docs, items = planted
    df = dc.contained_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
