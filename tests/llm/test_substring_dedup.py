"""Removed words against a loop over all windows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from salesloom.llm import common, substring_dedup as sd
from salesloom.llm.word_hash import sequence_hashes, word_hashes

SCHEMA = "doc_id long, text string, doc string, anchors string, row string"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute(rows):
    first = {}
    for i, t, *_ in rows:
        ws = words(t)
        for k in range(len(ws) - 12) if i is not None else ():
            key = tuple(ws[k : k + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        ws = words(t)
        gone = set()
        for k in range(len(ws) - 12) if i is not None else ():
            if first[tuple(ws[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), kept))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sd.substring_dedup(df)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_text"]
    expected = brute(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected
    digests = sd.substring_dedup(df, digest=True)
    assert sorted(((r.doc_id, r.kept_sha256) for r in digests.collect()), key=str) == sorted(
        ((i, hashlib.sha256(k.encode()).hexdigest()) for i, _, _, k in expected), key=str
    )


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    word = lambda: r.choice(["the", "of", "é", "".join(r.choice("abcd") for _ in range(4))])
    passages = [[word() for _ in range(r.randint(10, 60))] for _ in range(8)]
    out = []
    for i in range(150):
        ws = [word() for _ in range(r.choice([0, 5, 13, 40, 200]))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            at = r.randint(0, len(ws))
            ws[at:at] = p[a : a + r.randint(5, 60)]
        out.append((i * 7 % 150, r.choice([" ", "\n\t", "  "]).join(ws), None, None, None))
    return out


def test_random_texts_with_shared_passages(spark, rows):
    check(spark, rows)


def test_many_shards_and_salts_and_no_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(sd, "SHARD_ANCHORS", 20)
    monkeypatch.setattr(sd, "SALT_WORDS", 100)
    monkeypatch.setattr(sd, "SLICE_BYTES", 500)
    monkeypatch.setattr(sd, "RANGE_BYTES", 0)
    monkeypatch.setattr(sd, "maybe_broadcast", lambda df, n: common.maybe_broadcast(df, n, 0))
    check(spark, rows)


def test_nulls_repeats_and_long_texts(spark):
    p = " ".join(f"w{k}" for k in range(20))
    long = " ".join(f"v{k % 4999}" for k in range(30_000))
    check(spark, [
        (5, p, "", "", ""), (3, p, "", "", ""), (3, p, "", "", ""), (None, p, "", "", ""), (None, p, "", "", ""), (6, None, None, None, None), (7, "", "", "", ""),
        (8, " \x0b\x0c ", "", "", ""), (9, f"a {p} b {p} c", "", "", ""), (10, p.replace(" ", " "), "", "", ""), (11, long, "", "", ""), (12, long + " x", "", "", ""),
        (13, "same " * 40, "", "", ""), (14, "same " * 15, "", "", ""), (2, "same " * 12, "", "", ""),
    ])


def test_empty_table(spark):
    assert sd.substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_windows_are_judged_on_the_input():
    compiled, numbers = sd.compile_phrases([(4, b" ".join(b"%d" % k for k in range(15))), (2, b" ".join(b"%d" % k for k in range(1, 14)))])
    text = b" ".join(b"%d" % k for k in range(15))
    assert sd.locate(compiled, numbers, 9, text) == [(0, 15)]
    assert sd.locate(compiled, numbers, 4, text) == [(1, 14)]
    assert sd.locate(compiled, numbers, 2, text) == []
    assert sd.locate(*sd.compile_phrases([]), 9, text) == []


def test_hashes_do_not_depend_on_what_stands_beside():
    texts = [b"one two", b"", b"  two\x0bone ", b"two"]
    together, first = word_hashes(texts)
    apart = [word_hashes([t])[0] for t in texts]
    assert np.array_equal(together, np.concatenate(apart)) and first.tolist() == [0, 2, 2, 4, 5]
    assert together[0] == together[3] and together[1] == together[2] == together[4]
    assert len(sequence_hashes(together, 6)) == 0 and sequence_hashes(together[:2], 2)[0] != sequence_hashes(together[2:4], 2)[0]


def test_equal_segments_are_streamed_once(monkeypatch):
    words = [f"w{i}".encode() for i in range(40)]
    raw, other = b" ".join(words), b" ".join(words[5:30])
    seen = []

    class Counting:
        def __init__(self, machine):
            self.machine = machine

        def iter(self, ids):
            seen.append(ids)
            return self.machine.iter(ids)

    compile_phrases = sd.compile_phrases

    def counting(passages):
        (machine, docs), numbers = compile_phrases(passages)
        return (Counting(machine), docs), numbers

    monkeypatch.setattr(sd, "compile_phrases", counting)
    phrases = pa.table({"shard": [0], "salt": [0], "doc": [1], "passage": [raw]})
    docs, texts = [1, 2, 3, 4, 5], [raw, raw, other, raw, other]
    segments = pa.table({"doc": docs, "row": [d * 10 for d in docs], "start": [0, 7, 1, 0, 2], "segment": texts})
    got = sd._locate_group(phrases, segments)
    assert sorted(zip(*got.to_pydict().values())) == [(2, 20, 7, 47), (3, 30, 1, 26), (4, 40, 0, 40), (5, 50, 2, 27)]
    assert len(seen) == 2
