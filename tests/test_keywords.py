"""Keyword rules (F10-F13) and K6-K9."""

from __future__ import annotations

import pytest

from salesloom.operators import keywords as kw

PRODUCTS = [("P1", "G1"), ("P2", "G1"), ("P3", "G2"), ("P4", "G2"), ("P5", None), ("P6", "M01A"), ("P7", "m01b")]
TEXTS = [
    ("P1", "E", "Red ring clamp"),
    ("P1", "K", "RED RING CLAMP KO"),
    ("P2", "E", "string with gear"),      # RING inside STRING: substring semantics
    ("P3", "E", "blue mount"),
    ("P4", "E", None),
    ("P5", "E", "ring gear"),
    ("P6", "E", "bolt"),
    ("P7", "E", "ring rod gear"),
]


@pytest.fixture()
def frames(spark):
    products = spark.createDataFrame(PRODUCTS, "MATNR string, MATKL string")
    texts = spark.createDataFrame(TEXTS, "MATNR string, SPRAS string, MAKTX string")
    return products, texts


def _hits(spark, rule):
    df = spark.createDataFrame([(t,) for _, _, t in TEXTS], "MAKTX string")
    return [r.MAKTX for r in df.filter(rule.column("MAKTX")).collect()]


def test_rule_semantics(spark):
    assert _hits(spark, kw.any_of("ring")) == [
        "Red ring clamp", "RED RING CLAMP KO", "string with gear", "ring gear", "ring rod gear"]
    rule = kw.clause("RING", ("CLAMP", "ROD")) | kw.clause("BOLT")
    assert _hits(spark, rule) == ["Red ring clamp", "RED RING CLAMP KO", "bolt", "ring rod gear"]
    both = kw.any_of("RING", "BLUE") & kw.any_of("GEAR", "MOUNT")
    assert _hits(spark, both) == ["string with gear", "blue mount", "ring gear", "ring rod gear"]
    with pytest.raises(ValueError):
        kw.clause(())


def test_keyword_groups(spark, frames):
    products, texts = frames
    out = kw.keyword_groups(products, texts, kw.clause("RING", ("GEAR", "CLAMP")), lang="E").collect()
    # P5 has a NULL group: it forms its own group, as GROUP BY does, and a
    # NULL sorts as the largest value (last among equal counts).
    assert [(r.MATKL, r.CNT, r.SAMPLE1) for r in out] == [
        ("G1", 2, "Red ring clamp"), ("m01b", 1, "ring rod gear"), (None, 1, "ring gear")]
    fam = kw.keyword_groups(products, texts, None, lang="E", group_contains="m01", with_max=True).collect()
    assert [(r.MATKL, r.CNT, r.SAMPLE1, r.SAMPLE2) for r in fam] == [
        ("M01A", 1, "bolt", "bolt"), ("m01b", 1, "ring rod gear", "ring rod gear")]
    excl = kw.keyword_groups(products, texts, kw.any_of("RING"), lang="E", exclude=["G1"]).collect()
    assert [r.MATKL for r in excl] == ["m01b"]  # NOT IN drops the NULL group too
    top1 = kw.keyword_groups(products, texts, kw.any_of("A"), lang="E", n=1).collect()
    assert [(r.MATKL, r.CNT) for r in top1] == [("G1", 2)]


def test_group_profile(spark, frames):
    products, texts = frames
    out = kw.group_profile(products, texts, lang="E", groups=["G1", "G2"]).collect()
    assert [(r.MATKL, r.CNT, r.SAMPLE1, r.SAMPLE2) for r in out] == [
        ("G1", 2, "Red ring clamp", "string with gear"),
        ("G2", 2, "blue mount", "blue mount"),  # NULL text is ignored by MIN/MAX
    ]
    pre = kw.group_profile(products, texts, lang="E", prefix="M01", with_max=False).collect()
    assert [r.MATKL for r in pre] == ["M01A"]  # prefix is case-sensitive


def test_keyword_samples(spark, frames):
    products, texts = frames
    out = kw.keyword_samples(products, texts, kw.any_of("GEAR"), lang="E", n=2).collect()
    assert [(r.MAKTX, r.MATKL, r.MATNR) for r in out] == [
        ("ring gear", None, "P5"), ("ring rod gear", "m01b", "P7")]
    by_group = kw.keyword_samples(products, texts, kw.any_of("GEAR"), lang="E", n=3, order=("MATKL", "MAKTX"))
    assert [r.MATNR for r in by_group.collect()] == ["P2", "P7", "P5"]  # NULL group last
    g = kw.keyword_samples(products, texts, None, lang="E", group="G1", n=10).collect()
    assert [r.MATNR for r in g] == ["P1", "P2"]


def test_keyword_split_adds_up(spark, frames):
    products, texts = frames
    rule = kw.any_of("RING", "BLUE")
    out = {r.TYPE: (r.CNT, r.SAMPLE) for r in
           kw.keyword_split(products, texts, rule, lang="E", group="G2").collect()}
    assert out == {"Match": (1, "blue mount"), "Other": (1, None)}  # NULL text -> ELSE
    total = kw.group_profile(products, texts, lang="E", groups=["G2"]).first().CNT
    assert sum(c for c, _ in out.values()) == total


def test_whole_text_is_searched(spark):
    long_text = " ".join(["filler"] * 20_000) + " Bolt"
    products = spark.createDataFrame([("P9", "G9")], "MATNR string, MATKL string")
    texts = spark.createDataFrame([("P9", "E", long_text)], "MATNR string, SPRAS string, MAKTX string")
    out = kw.keyword_groups(products, texts, kw.any_of("BOLT"), lang="E").collect()
    assert [(r.MATKL, r.CNT) for r in out] == [("G9", 1)]
    assert len(out[0].SAMPLE1) == len(long_text)
