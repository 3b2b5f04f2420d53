"""Near-duplicate classes against all pairs, the sampler, components."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from salesloom.llm import common, near_dup as nd
from salesloom.llm.components import components

SCHEMA = "doc_id long, text string, class_id string, member string, bucket string"


def find(parent, x):
    parent.setdefault(x, x)
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def weighted_sets(texts):
    """Weighted shingle sets by the definition, with words and dicts."""
    counts = []
    for t in texts:
        ws = (t or "").encode().translate(nd._FOLD).split()
        k = min(5, len(ws))
        counts.append(Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if ws else Counter())
    df = Counter(s for c in counts for s in c)
    n = max(1, len(texts))
    idf = {s: 1 + min(1, math.log(n / k) / math.log(64)) if k > n / 64 else 2.0 for s, k in df.items()}
    return [{s: k * idf[s] for s, k in c.items()} for c in counts]


def brute(rows):
    sets, parent = weighted_sets([t for _, t, *_ in rows]), {}
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    links = {(a, b) for hs in holders.values() for a in hs for b in hs if a < b}
    for a, b in links:
        x, y = sets[a], sets[b]
        both = sum(min(w, y[g]) for g, w in x.items() if g in y)
        if None not in (rows[a][0], rows[b][0]) and both / (sum(x.values()) + sum(y.values()) - both) >= 0.8 - 1e-9:
            p, q = find(parent, rows[a][0]), find(parent, rows[b][0])
            parent[max(p, q)] = min(p, q)
    return sorted(((i, None if i is None else find(parent, i)) for i, *_ in rows), key=str)


def check(spark, rows):
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "class_id", "kept"]
    found = got.collect()
    assert sorted(((r.doc_id, r.class_id) for r in found), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.class_id) for r in found)


def edited(r, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[r.randrange(len(ws))] = "".join(r.choice("xyz") for _ in range(6))
    return ws


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    common_line = [word() for _ in range(25)]
    out, ids = [], random.Random(1).sample(range(1000), 260)
    for _ in range(40):
        base = [word() for _ in range(r.choice([60, 150, 400]))] + (common_line if r.random() < 0.4 else [])
        for n in [0, 0, 1, 1, 2, 4, 12][: r.randint(1, 7)]:
            out.append((ids.pop(), " ".join(edited(r, base, n)), None, None, None))
    return out


def test_classes_are_those_of_all_pairs(spark, rows):
    check(spark, rows)


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(nd, "MEMBERS", 16)
    monkeypatch.setattr(nd, "COLUMNS", 100)
    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
    check(spark, [(i, " ".join(edited(r, base, r.randint(0, 6))), None, None, None) for i in range(150)])


def test_counting_by_join_and_joins_without_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(nd, "CANDIDATES", 0)
    monkeypatch.setattr(nd, "BLOCK", 500)
    monkeypatch.setattr(nd, "maybe_broadcast", lambda df, n: common.maybe_broadcast(df, n, 0))
    check(spark, rows)


def test_nulls_short_texts_and_repeats(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    check(spark, [
        (1, None, "", "", ""), (2, "", None, None, None), (3, "!! ...", "", "", ""), (4, "One two", "", "", ""), (5, "one, TWO!", "", "", ""),
        (6, "one three", "", "", ""), (None, "one two", "", "", ""), (8, "a b c d e f g", "", "", ""), (8, "a b c d e f g", "", "", ""), (9, long, "", "", ""),
        (7, long + " more words at the end", "", "", ""),
    ])


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_samples_agree_as_often_as_sets_are_similar():
    r = np.random.default_rng(1)
    grams = np.sort(r.integers(0, 2**63, 300, dtype=np.uint64))
    w = r.choice([1.0, 2.0, 3.5], 300)
    one, two = np.arange(0, 220), np.arange(60, 300)
    w2 = np.where(np.arange(300) % 3 == 0, w * 1.5, w)
    both = np.concatenate([grams[one], grams[two]])
    got = nd.samples(both, np.concatenate([w[one], w2[two]]), np.array([0, 220]), 3000)
    least, most = np.zeros(300), np.zeros(300)
    least[60:220] = np.minimum(w, w2)[60:220]
    most[one], most[220:] = w[one], w2[220:]
    most[60:220] = np.maximum(w, w2)[60:220]
    expected = least.sum() / most.sum()
    assert abs((got[0] == got[1]).mean() - expected) < 4 * math.sqrt(expected * (1 - expected) / 3000)
    assert nd.weighted_jaccard(grams[one], w[one], grams[two], w2[two]) == pytest.approx(expected)


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(100, 140)] + [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(120)]
    links += [(5000, 5000 + i) for i in range(1, 30)] + [(7, 7)]
    parent = {}
    for a, b in links:
        if a != b:
            p, q = find(parent, a), find(parent, b)
            parent[max(p, q)] = min(p, q)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(parent, x)) for x in list(parent))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_link_tasks_give_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(nd, "give_back", lambda: given.append(1))
    assert list(nd._link_rows(0.8)(iter([]))) == [] and given == [1]
