"""Collocations against plain counting; the summaries' guarantee."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from salesloom.llm import collocations as co

LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
SCHEMA = "lang string, text string, `group` string, phrase int, n int"


def counted(rows):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und" if lang is None else lang] += len(words)
            for k in range(1, 5):
                f["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return f, n


def brute(rows, threshold, most=2_000):
    f, n = counted(rows)
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) >= 2 and a >= threshold}
        kept = []
        for p, a in frequent.items():
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            inside = [b for q, b in frequent.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= 80 * a for b in inside):
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def run(spark, rows, **more):
    docs = spark.createDataFrame([(a, b, "clash", 1, 2) for a, b in rows], SCHEMA)
    return sorted(tuple(r) for r in co.collocations(docs, **more).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = ["New", "york", "the", "of", "Élan", "ÀÉ", "a-b", "x\x00y", " nbsp", "日本"]
    gaps = [" ", " ", "  ", "\t", ". ", ",", "\n", " \t ", "!?", "\r\n", "\x0b"]
    out = [(rng.choice(["en", "fr", None, ""]), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 80)))) for _ in range(120)]
    return [*out, ("en", None), (None, None), ("de", ""), ("de", " . ,"), ("en", "new york city hall " * 500), ("und", "new york"), ("x", "once")] + [("copy", "same old story again")] * 40


@pytest.mark.parametrize("threshold", [1, 3, 30])
def test_matches_plain_counting(spark, rows, threshold):
    assert run(spark, rows, threshold=threshold) == brute(rows, threshold)


def test_first_rows_of_a_group(spark, rows):
    assert run(spark, rows, threshold=2, most=5) == brute(rows, 2, most=5)


@pytest.mark.parametrize("phrases", [20, 150, 400])
def test_small_bounds_lose_nothing(spark, rows, monkeypatch, phrases):
    """Summaries that are sent early and cut down often, and a full bitmap."""
    texts = spark.createDataFrame(rows, "group string, text string").select(F.coalesce("group", F.lit("und")).alias("group"), F.coalesce("text", F.lit("")).alias("text"))
    f, n = counted(rows)
    wanted = sorted((g, len(p), " ".join(p), a) for g, c in f.items() for p, a in c.items() if a >= 10)
    for name, value in (("SLICE_BYTES", 2_000), ("SEND", 300), ("PIECE", 40), ("MERGE", 50), ("PHRASES", phrases), ("MOST_BITS", 16)):
        monkeypatch.setattr(co, name, value)
    words = co.bitmap(co.stored(co.survivors(texts, 10, 8, range(1, 2)), "test"))
    several = co.bitmap(co.stored(co.survivors(texts, 10, 8, range(2, 5), words), "test"))
    got = co.count_phrases(texts, words, several, 10, 8)
    assert sorted(tuple(r) for r in got.filter("size > 0").collect()) == wanted
    assert {r.group: r.n for r in got.filter("size = 0").collect() if r.n} == {g: c for g, c in n.items() if c}


def test_planes_round_trip():
    for a in ([], [0], [5, 5, 9], [1 << 63, (1 << 64) - 1]):
        assert co._from_planes(co._planes(np.array(a, np.uint64))).tolist() == a


def test_every_frequent_hash_keeps_a_counter(monkeypatch):
    monkeypatch.setattr(co, "MERGE", 100)
    rng = np.random.default_rng(3)
    stream = rng.permutation(np.concatenate([np.repeat(np.arange(20), 30), rng.integers(1_000, 6_000, 9_000), np.repeat(np.arange(50, 90), 29)])).astype(np.uint64)
    summary = co.MisraGries(len(stream) // 30 + 1)
    for part in np.array_split(stream, 40):
        summary.add(*co._counted(part))
    summary.cut()
    assert 0 < summary.removed < 30 and len(summary._merge()[0]) <= summary.capacity
    assert set(range(20)) <= set(summary.survivors(30).tolist())


def test_exact_past_64_bits(spark):
    """2,000,000 a leaves 64 bits."""
    big = 1 << 44
    counts = spark.createDataFrame([("g", 0, "", 9), ("g", 1, "x", big), ("g", 1, "y", 3 * big + 1), ("g", 2, "x y", big)], "group string, size int, phrase string, n long")
    assert [tuple(r) for r in co._scored(counts, 80).collect()] == [("g", "x y", big, big, 3 * big + 1, 2_000_000 * big // (4 * big + 1))]


def test_bitmap_has_the_leading_bits(spark):
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 5_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    filled, bits = co.bitmap(spark.createDataFrame([(int(h),) for h in hashes.view(np.int64)], "hash long"))
    seen = np.unpackbits(np.frombuffer(filled, np.uint8), bitorder="little")
    assert len(seen) == 1 << bits and set(np.flatnonzero(seen).tolist()) == {int(h) >> (64 - bits) for h in hashes}


def test_ranking_by_shares(spark):
    """A group with many more phrases than are asked for, ties included."""
    rows = [("g", f"p{i} q", i % 50 + 1, 9, 9, i % 7) for i in range(3_000)]
    scored = spark.createDataFrame(rows, "group string, phrase string, a long, l long, r long, score long")
    counts = spark.createDataFrame([("g", 0, "", 12)], "group string, size int, phrase string, n long")
    got = [(r.rank, r.phrase) for r in co._ranked(scored, counts, "lang", 700).orderBy("rank").collect()]
    assert got == list(enumerate((r[1] for r in sorted(rows, key=lambda r: (-r[5], -r[2], r[1]))[:700]), 1))


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [("en", None), ("en", "")]) == []


class _Tasks:
    """Stands for a table of texts, and keeps the functions that would run over it."""

    def __init__(self):
        self.work = []
        self.sparkSession = self.sparkContext = self

    def broadcast(self, value):
        self.value = value
        return self

    def mapInArrow(self, function, _):
        self.work.append(function)
        return self

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition


def test_tasks_give_memory_back(spark, monkeypatch):
    given = []
    monkeypatch.setattr(co, "give_back", lambda: given.append(1), raising=False)
    tasks, everything = _Tasks(), (b"\xff" * (1 << 13), 16)
    co.survivors(tasks, 2, 8, range(1, 2))
    co.count_phrases(tasks, everything, everything, 2, 8)
    batch = pa.RecordBatch.from_pylist([{"group": "en", "text": "a b a b"}])
    tasks.value = (everything, everything)
    for first, second in (tasks.work[:2], tasks.work[2:]):
        assert sum(b.num_rows for b in second(iter(list(first(iter([batch])))))) > 0
    assert len(given) == 4


def test_text_batches_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, str(64 << 20))
        co.collocations(spark.createDataFrame([("en", "a b " * 40)], "lang string, text string")).count()
        assert int(spark.conf.get(name).removesuffix("b")) <= 8 << 20
    finally:
        spark.conf.set(name, before)
