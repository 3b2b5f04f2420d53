"""Merkle manifest against plain loops."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from salesloom.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, `key` int"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def H(*parts) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row) -> str:
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """(root, for each node its [(siblings, slot)] up to the root)"""
    paths, spots = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(spots):
            run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
            paths[i].append((run[: at % 16] + run[at % 16 + 1 :], at % 16))
            spots[i] = at // 16
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows, tampered=True):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    first = lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))
    trees = {s: climb([leaf_of(r) for r in sorted(by_source[s], key=first)]) for s in order}
    root, above = climb([trees[s][0] for s in order])
    out = []
    for s, upper in zip(order, above):
        for row, path in zip(sorted(by_source[s], key=first), trees[s][1]):
            hit = tampered and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            now = leaf_of((*row[:4], row[4] and row[4].translate(str.maketrans(UPPER, LOWER)))) if hit else leaf_of(row)
            for siblings, slot in path + upper:
                now = H(*siblings[:slot], now, *siblings[slot:])
            out.append((row[0], leaf_of(row), trees[s][0], root, H(*(x for sib, _ in path + upper for x in sib)), now, now == root))
    return sorted(out, key=str)


def run(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    lowered = {"text": F.translate("text", UPPER, LOWER)}
    got = merkle.manifest(docs, COLUMNS, presented=lowered, where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, **more)
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_states_fold_any_slot():
    children = [H(str(i)).encode() for i in range(16)]
    parent = merkle.Parent(children)
    assert parent.digest.decode() == H(*(c.decode() for c in children))
    for slot in range(16):
        other = [*children[:slot], b"x" * 64, *children[slot + 1 :]]
        assert parent.fold(slot, b"x" * 64) == merkle.Parent(other).digest
        assert parent.siblings(slot) == b"".join(children[:slot] + children[slot + 1 :])


def test_hard_rows(spark):
    rows = [
        (3, "a", "en", 5, "Hello"), (1, "a", None, None, None), (2, "a", "en", 0, ""), (2, "a", "en", 0, ""), (2, "a", "de", 3, "ÄÖÜ é"),
        (None, "a", "en", 1, "X"), (None, "a", "en", 1, "Y"), (7, None, "en", 1, "NULL SOURCE"), (8, "", "en", 1, "EMPTY SOURCE"), (9, "Z", None, 2, "One Row"),
        (10, "é", "x", -4, "A" * 300_000), (5, "-", "-", 1, "-"),
    ]
    got = run(spark, rows)
    assert got == brute(rows)
    assert len({r[3] for r in got}) == 1


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_sizes_of_one_source(spark, n):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
    assert run(spark, rows) == brute(rows)


def test_hot_source_many_sources_and_repeats(spark):
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(4_400)]
    rows += [(i, f"s{i}", None, 1, "T") for i in range(300)]
    rows += [(77, "copies", "en", 9, "The Same")] * 600
    assert run(spark, rows) == brute(rows)


def test_only_tampered_rows_fail(spark):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(50)]
    for doc_id, *_, verified in run(spark, rows):
        assert verified == (zlib.crc32(str(doc_id).encode()) % 5 != 0)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert all(r.verified and r.folded_root == r.root for r in merkle.manifest(docs, COLUMNS).collect())


def test_empty_table(spark):
    assert run(spark, []) == []
