"""Key filter (J3), K3 with reduced lines, K5 with shared headers."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from salesloom.operators import orders
from salesloom.operators.joins import key_filter
from salesloom.plans import digest, registry
from salesloom.sources import stored
from tests.conftest import HEADER_SCHEMA, LINE_SCHEMA, d, money, qty

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("bits", [6, 12, 22, 30])
def test_rows_with_a_partner_pass(spark, bits):
    fact = spark.range(4_000).select((F.col("id") % 1_000).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("b"), "id")
    keys = spark.range(0, 1_000, 5).select(F.col("id").alias("a"), (F.col("id") % 3).alias("b")).union(spark.createDataFrame([(None, 1), (3, None)], "a long, b long"))
    got = key_filter(fact, keys, ["a", "b"], bits)
    assert got.columns == fact.columns
    wanted = {r.id for r in fact.join(keys, ["a", "b"], "left_semi").collect()}
    found = {r.id for r in got.collect()}
    assert wanted <= found and all(r.b is not None for r in got.select("b").collect())
    if bits >= 22:
        assert len(found) < 1.05 * len(wanted) + 5


def test_no_keys_and_bad_bits(spark):
    fact = spark.range(10)
    assert key_filter(fact, spark.range(0), ["id"]).count() == 0
    assert key_filter(fact.limit(0), spark.range(5), ["id"]).count() == 0
    for bits in (5, 31):
        with pytest.raises(ValueError):
            key_filter(fact, fact, ["id"], bits)


def _tables(spark, seed: int):
    rng = random.Random(seed)
    day = lambda: d(f"2026-01-{rng.randint(1, 20):02d}")
    header = [
        (rng.choice([f"H{i}", None]) if rng.random() < 0.02 else f"H{i}", day(), day(), "A", "C", rng.choice("ABC"), rng.choice(["C", "O", None]), money(rng.randint(1, 99)), "EUR")
        for i in range(60) for _ in range(rng.randint(1, 3))
    ]
    lines = [
        (f"H{rng.randint(0, 70)}", f"{rng.randint(1, 3)}", day(), day(), qty(rng.randint(0, 9)), qty(rng.randint(0, 9)))
        for _ in range(400)
    ]
    return spark.createDataFrame(header, HEADER_SCHEMA), spark.createDataFrame(lines, LINE_SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_reduced_lines_give_the_same_report(spark, seed):
    header, lines = _tables(spark, seed)
    plain = [tuple(r) for r in orders.delayed_lines(header, lines, as_of=d("2026-02-01"), n=50).collect()]
    assert plain
    for bits in (6, 22):
        assert [tuple(r) for r in orders.delayed_lines(header, lines, as_of=d("2026-02-01"), n=50, filter_bits=bits).collect()] == plain
    opened = orders.open_headers(header)
    assert [tuple(r) for r in orders.delayed_lines(None, lines, as_of=d("2026-02-01"), n=50, filter_bits=22, opened=opened).collect()] == plain


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_lines_of_closed_orders_are_in_no_shuffle(spark):
    """Between each scan of lines and the first exchange above it stands the filter."""
    rows = executed(registry.jobs()["k3_delayed_lines_reduced"](spark, SF)).split("\n")
    depth = lambda line: len(re.match(r"[ :|+\-]*", line)[0])
    scans = [i for i, line in enumerate(rows) if "FileScan parquet" in line and "l_linenumber" in line]
    assert scans
    for i in scans:
        above, at = [], depth(rows[i])
        for line in reversed(rows[:i]):
            if depth(line) < at:
                at = depth(line)
                above.append(line)
        first = next((k for k, line in enumerate(above) if re.search(r"(Exchange |Join \[VBELN)", line) and "_word" not in line), len(above))
        assert any("getbit" in line for line in above[:first]) and any("BroadcastHashJoin" in line for line in above[:first])


def test_digest_shares_the_open_orders(spark):
    header, lines = _tables(spark, 3)
    args = dict(as_of=d("2026-02-01"), n=9, delayed_n=9)
    shared = [tuple(r) for r in digest.daily_digest(header, lines, **args).collect()]
    assert shared == [tuple(r) for r in digest.daily_digest(header, lines, shared=False, **args).collect()]


def test_digest_reads_the_stored_orders(spark):
    """Two reads of the lines, and of the stored open orders instead of the header table."""
    plan = executed(registry.jobs()["k5_digest_lines"](spark, SF))
    assert "/orders.parquet" not in plan
    assert len(re.findall(r"FileScan parquet [^\n]*/lineitem.parquet", plan)) <= 2
    assert len(re.findall(r"FileScan parquet [^\n]*/open-orders-", plan)) <= 3


def test_stored_needs_a_shared_folder(spark, monkeypatch):
    df = stored.stored(spark.range(5), "five")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3, 4] and df.inputFiles()

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(ValueError):
        stored.shared_folder(Cluster)


def test_sales_by_any_order_are_the_same(spark):
    jobs = registry.jobs()
    plain = sorted(map(tuple, jobs["k10_monthly_sales_paired"](spark, SF).collect()))
    for name in ("k10_monthly_sales_by_size", "k10_monthly_sales_reduced"):
        assert sorted(map(tuple, jobs[name](spark, SF).collect())) == plain and plain


def test_the_dimension_that_keeps_less_is_joined_first(spark):
    from salesloom.operators import sales

    lines = spark.createDataFrame([("D1", d("2026-01-01"), "M1", qty(1), money(5))], "VBELN string, FILE_DATE date, MATNR string, FKIMG decimal(18,3), NETWR decimal(18,2)")
    products = spark.createDataFrame([(f"M{i}", "G1" if i < 8 else "G2") for i in range(10)], "MATNR string, MATKL string")
    heads = lambda kept: spark.createDataFrame([(f"D{i}", d("2026-01-01"), "F2", "USD" if i < kept else "EUR", d("2026-01-01")) for i in range(10)], "VBELN string, FILE_DATE date, FKART string, WAERK string, FKDAT date")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for kept, first in ((9, "MATNR"), (2, "VBELN")):
            df = sales.monthly_sales(lines, heads(kept), products, groups=["G1"], currency="USD", join_order="size")
            assert [(r.YEARMONTH, r.QTY) for r in df.collect()] == [("2026-01", 1)]
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            joins = re.findall(r"Join Inner, \(?\(?(\w+)#", plan)
            assert joins[-1] == first, plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    with pytest.raises(ValueError):
        sales.monthly_sales(lines, heads(1), products, join_order="best")
