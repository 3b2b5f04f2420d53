"""Phrases and the set-similarity join against a plain loop."""

from __future__ import annotations

import random
import re

import pytest

from salesloom.llm import license_scan as ls, queries

SCHEMA = "doc_id long, text string, words string, labels string, _words string"


def words(text):
    return [w for w in re.split(ls.GAP, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def brute(rows, threshold=0.9, templates=None):
    out = []
    for i, t, *_ in rows:
        ws = words(t)
        places = [(k, label) for k in range(len(ws)) for p, label in ls.PHRASES.items() if ws[k : k + len(p.split())] == p.split()]
        base = {label for _, label in places}
        hits = {}
        for line in (t or "").split("\n"):
            have = set(words(line))
            for label, notice in templates or ls.TEMPLATES:
                want = set(words(notice))
                if len(have & want) >= threshold * len(want) - 1e-9:
                    hits[label] = max(hits.get(label, 0), len(have & want) / len(want))
        out.append((
            i, len(ws), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None),
            ",".join(sorted(base)), ",".join(sorted(base | set(hits))), 1.0 if places else max(hits.values(), default=0.0),
        ))
    return sorted(out, key=str)


def check(spark, rows, **kw):
    got = ls.license_scan(spark.createDataFrame(rows, SCHEMA), **kw)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, **kw)


def test_random_lines_of_template_words(spark):
    r = random.Random(4)
    pool = [t for _, t in ls.TEMPLATES]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(r.randint(1, 4)):
            ws = r.choice(pool).split()
            r.shuffle(ws)
            ws = [w for w in ws if r.random() > 0.08] + r.sample(["zebra", "the", "MIT", "license", "of"], r.randint(0, 3))
            lines.append(" ".join(ws))
        rows.append((i, "\n".join(lines), None, None, None))
    check(spark, rows)
    check(spark, rows, threshold=0.6)


def test_edges(spark):
    check(spark, [
        (1, None, "", "", ""), (None, "", "", "", ""), (2, "MIT License. mit-license; mit license", "x", None, None), (3, "cc by cc by nc", "", "", ""),
        (4, "gnu general public\nlicense", "", "", ""), (5, "mit", "", "", ""), (5, "mit", "", "", ""), (6, "Émit license apache  LICENSE", "", "", ""),
        (7, "word " * 60_000 + "apache license", "", "", ""), (8, "Released under the MIT License.\nReleased under the MIT License.", "", "", ""),
        (9, "permit licenses cc byte", "", "", ""),
    ])


def test_empty_table(spark):
    assert ls.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_prefixes_hold_the_rarest_words(spark):
    docs = spark.createDataFrame([(i, "the license", None, None, None) for i in range(5)] + [(9, "mit", None, None, None)], SCHEMA)
    order = ls.global_order(docs, [("mit", "released under the MIT license")], "text")
    assert order == ["released", "under", "mit", "license", "the"]
    (t,) = ls.ordered_templates([("mit", "released under the MIT license")], order, 0.8)
    assert t.needed == 4 and t.prefix == ("released", "under")


def test_the_order_is_counted_over_all_rows(spark, monkeypatch):
    # in the first 1,000 rows "the" is the only word of the template, in all rows it is the rarest
    rows = [(i, "the" if i < 1_000 else "mit license released", None, None, None) for i in range(3_000)]
    seen = []
    join = ls._join
    monkeypatch.setattr(ls, "_join", lambda *args: seen.append(args[-1]) or join(*args))
    ls.license_scan(spark.createDataFrame(rows, SCHEMA).coalesce(1), templates=[("mit", "Released the MIT license")], windows=True)
    assert seen == [["the", "license", "mit", "released"]]


def test_no_python_in_the_plan(spark):
    plan = ls.license_scan(spark.createDataFrame([(1, "a", "", "", "")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_own_templates(spark):
    own = [("house", "all rights reserved by the house")]
    rows = [(1, "All rights reserved, by The House!", None, None, None), (2, "all rights", None, None, None)]
    got = {r.doc_id: r.labels for r in ls.license_scan(spark.createDataFrame(rows, SCHEMA), templates=own).collect()}
    assert got == {1: "house", 2: ""}
    assert ls.license_scan(spark.createDataFrame(rows, SCHEMA), templates=[]).filter("labels != ''").count() == 0


@pytest.mark.parametrize("n", [1, 5, 14])
def test_needed_is_a_rounded_up_share(n):
    text = " ".join(f"w{i}" for i in range(n))
    (t,) = ls.ordered_templates([("x", text)], text.split(), 0.8)
    assert t.needed >= 0.8 * n > t.needed - 1


def brute_windows(rows, threshold=0.9, templates=None):
    """{row: (labels of templates, largest containment)} by every window of every template."""
    out = []
    for _, t, *_ in rows:
        ws, hits = words(t), {}
        for label, notice in templates or ls.TEMPLATES:
            want, step = set(words(notice)), -(-len(words(notice)) // 2)
            for s in range(0, len(ws), step):
                share = len(set(ws[s : s + 4 * step]) & want) / len(want)
                spelt = f" {' '.join(ws[s : s + 4 * step])} "
                if not all(f" {p} " in spelt for p in (ls.TELLING[notice] if templates is None else [])):
                    continue
                if share * len(want) >= threshold * len(want) - 1e-9:
                    hits[label] = max(hits.get(label, 0), share)
        out.append(hits)
    return out


def check_windows(spark, rows, **kw):
    plain = {r[0]: r for r in brute(rows, templates=[("none", "no such words anywhere at all")])}
    expected = []
    for (i, *_), hits in zip(rows, brute_windows(rows, **kw)):
        _, n, n_base, first, last, base, _, _ = plain[i]
        labels = {b for b in base.split(",") if b} | set(hits)
        expected.append((i, n, n_base, first, last, base, ",".join(sorted(labels)), 1.0 if n_base else max(hits.values(), default=0.0)))
    got = ls.license_scan(spark.createDataFrame(rows, SCHEMA), windows=True, **kw).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(expected, key=str)


def wrapped(text, width, mark=""):
    lines, ws = [], text.split()
    while ws:
        k = next((k for k in range(len(ws), 1, -1) if len(" ".join(ws[:k])) <= width), 1)
        lines.append(mark + " ".join(ws[:k]))
        ws = ws[k:]
    return "\n".join(lines)


def test_windows_find_wrapped_notices(spark):
    rows, wanted = [], []
    for i, (label, notice) in enumerate(ls.TEMPLATES):
        for k, (width, mark) in enumerate([(72, ""), (40, "# "), (20, " * ")]):
            rows.append((100 * i + k, "word " * (7 * i + k) + "\n" + wrapped(notice, width, mark) + "\n" + "end " * 30, None, None, None))
            wanted.append(label)
    got = {r.doc_id: (r.labels.split(","), r.score) for r in ls.license_scan(spark.createDataFrame(rows, SCHEMA), windows=True).collect()}
    base = set(ls.PHRASES.values())
    assert all(got[r[0]][1] == 1.0 and set(got[r[0]][0]) - base == {label} - base for label, r in zip(wanted, rows))
    check_windows(spark, rows)


def test_each_notice_has_its_own_label_only(spark):
    rows = [(i, notice, None, None, None) for i, (_, notice) in enumerate(ls.TEMPLATES)]
    got = {r.doc_id: (r.base_labels, r.labels) for r in ls.license_scan(spark.createDataFrame(rows, SCHEMA), windows=True).collect()}
    for i, (label, _) in enumerate(ls.TEMPLATES):
        base, labels = got[i]
        assert set(labels.split(",")) == {label} | set(filter(None, base.split(",")))


def test_neighbours_and_versions(spark):
    cases = {
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License": "",
        "This work is licensed under the GNU General Public License, version 2": "gpl",
        "Licensed under CC BY-NC-SA 4.0": "cc-by",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "lgpl",
        "Licensed under the Apache License, Version 1.1": "apache",
    }
    rows = [(i, text, None, None, None) for i, text in enumerate(cases)]
    got = ls.license_scan(spark.createDataFrame(rows, SCHEMA), windows=True).orderBy("doc_id").collect()
    assert [r.labels for r in got] == list(cases.values())
    both = " ".join(n for label, n in ls.TEMPLATES if label in ("lgpl", "agpl"))
    (r,) = ls.license_scan(spark.createDataFrame([(1, both, None, None, None)], SCHEMA), windows=True).collect()
    assert r.labels == "agpl,lgpl"
    check_windows(spark, [*rows, (99, both, None, None, None)])


def test_repeated_ids_keep_their_own_labels(spark):
    rows = [(1, "Released under the MIT License", None, None, None), (1, "nothing", None, None, None), (None, ls.TEMPLATES[7][1], None, None, None), (None, "", None, None, None)]
    got = sorted(str((r.doc_id, r.labels)) for r in ls.license_scan(spark.createDataFrame(rows, SCHEMA), windows=True).collect())
    assert got == sorted(map(str, [(1, "mit"), (1, ""), (None, "agpl"), (None, "")]))


def test_templates_are_joined(spark):
    plan = ls.license_scan(spark.createDataFrame([(1, "a", "", "", "")], SCHEMA), windows=True)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Join Inner") >= 2


def test_windows_of_long_lines(spark):
    far = "released " + "x " * 500 + "under the " + "y " * 500 + "MIT " + "z " * 500 + "License"
    near = "x " * 777 + "Released under the MIT, well, License" + " y" * 777
    rows = [(1, far, None, None, None), (2, near, None, None, None), (3, "", None, None, None), (4, None, None, None, None)]
    got = {r.doc_id: r.labels for r in ls.license_scan(spark.createDataFrame(rows, SCHEMA), windows=True).collect()}
    assert got == {1: "", 2: "mit", 3: "", 4: ""}
    check_windows(spark, rows)


def test_random_windows(spark):
    r = random.Random(5)
    pool, rows = [t for _, t in ls.TEMPLATES], []
    for i in range(120):
        ws = []
        for _ in range(r.randint(1, 5)):
            part = [w for w in r.choice(pool).split() if r.random() > 0.06]
            for _ in range(r.randint(0, 6)):
                part.insert(r.randint(0, len(part)), r.choice(["zebra", "the", "license", "of"]))
            ws += part + ["filler"] * r.randint(0, 40)
        rows.append((i, "".join(w + r.choice("    \n") for w in ws), None, None, None))
    check_windows(spark, rows)
    check_windows(spark, rows, threshold=0.6)
    assert ls.license_scan(spark.createDataFrame(rows, SCHEMA), templates=[], windows=True).count() == 120


def test_registered_query_finds_wrapped_notices(spark, tmp_path):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this\nsoftware and associated documentation files"
    spark.createDataFrame([(1, mit)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    (row,) = queries.op9_license_scan(spark, str(tmp_path)).collect()
    assert (row.labels, row.score) == ("mit", 1.0)
