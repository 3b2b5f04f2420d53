"""Many keyword searches in one pass: the same rows as one search at a time, one read and one
fold of the texts."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from salesloom.operators import keywords as kw
from salesloom.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(5)
    words = ["Red", "ring", "GEAR", "bolt", "straße", "clamp", "T1", "T70", "t130", "x"]
    products = [(f"P{i}", rng.choice(["G1", "G2", "M01A", "m01b", None])) for i in range(300)]
    texts = [(f"P{rng.randint(0, 320)}", rng.choice("EK"), rng.choice([None, "", *(" ".join(rng.choices(words, k=4)) for _ in range(9))])) for _ in range(900)]
    return spark.createDataFrame(products, "MATNR string, MATKL string"), spark.createDataFrame(texts, "MATNR string, SPRAS string, MAKTX string")


#: More terms than one word of the bitmap holds.
WIDE = kw.any_of(*(f"t{i}" for i in range(0, 140, 2))) & kw.any_of("ring", "t1")
SEARCHES = {
    "all": None, "plain": kw.any_of("ring"), "wide": WIDE, "either": kw.clause("RED", ("GEAR", "bolt")) | kw.clause("STRASSE"), "none": kw.any_of("zzz"),
    "in": kw.Search(kw.any_of("x"), include=("G1", "M01A")), "out": kw.Search(kw.any_of("x"), exclude=("G1",)), "has": kw.Search(None, group_contains="m01"),
    "starts": kw.Search(kw.any_of("gear", "x"), group_prefix="G"),
}


def test_the_same_groups_as_one_by_one(spark, frames):
    products, texts = frames
    got = [tuple(r) for r in kw.keyword_rules(products, texts, SEARCHES, lang="E").collect()]
    wanted = []
    for name in sorted(SEARCHES):
        s = kw._as_search(SEARCHES[name])
        one = kw.keyword_groups(products, texts, s.rule, "E", s.include, s.exclude, s.group_contains, s.group_prefix, with_max=True)
        wanted += [(name, *r) for r in one.collect()]
    assert got == wanted and {r[0] for r in got} == set(SEARCHES) - {"none"}


def test_the_same_samples_as_one_by_one(spark, frames):
    products, texts = frames
    got = [tuple(r) for r in kw.keyword_rule_samples(products, texts, SEARCHES, lang="E", n=7, shares=3).orderBy("SEARCH", "POS").collect()]
    wanted = []
    for name in sorted(SEARCHES):
        s = kw._as_search(SEARCHES[name])
        hits = kw.keyword_matches(products, texts, {name: s}, lang="E").collect()
        key = lambda r: tuple((v is None, v or "") for v in r)
        first = sorted(((r.MAKTX, r.MATKL, r.MATNR) for r in hits), key=key)[:7]
        wanted += [(name, i, *r) for i, r in enumerate(first, 1)]
    assert got == wanted


def test_null_text_and_no_search(spark, frames):
    products, texts = frames
    nulls = texts.withColumn("MAKTX", F.lit(None).cast("string"))
    assert {r.SEARCH for r in kw.keyword_matches(products, nulls, SEARCHES, lang="E").select("SEARCH").distinct().collect()} == {"all", "has"}
    assert kw.keyword_rules(products, texts.limit(0), SEARCHES).count() == 0
    with pytest.raises(ValueError):
        kw.keyword_rules(products, texts, {})


@pytest.mark.parametrize("name", ["k6_keyword_rules", "k8_keyword_rule_samples"])
def test_texts_are_read_and_folded_once(spark, name):
    df = registry.jobs()[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    reads = re.findall(r"ReadSchema: struct<([^\n]*)>", plan)
    assert sum("text:string" in r for r in reads) == 1
    assert plan.count("upper(text") == 1
