"""K10 monthly sales (both snapshot modes) and K13 extract."""

from __future__ import annotations

import pytest

from salesloom.operators import sales
from tests.conftest import d, money, qty

LINE = "VBELN string, POSNR string, MATNR string, FKIMG decimal(18,3), NETWR decimal(18,2), FILE_DATE date"
HEAD = "VBELN string, FKART string, WAERK string, FKDAT date, FILE_DATE date"


@pytest.fixture()
def tables(spark):
    lines = spark.createDataFrame([
        ("9001", "10", "M1", qty(2), money(10), d("2026-05-01")),
        ("9001", "10", "M1", qty(2), money(10), d("2026-06-01")),   # same line, next load
        ("9002", "10", "M2", qty(5), money(50), d("2026-06-01")),
        ("9003", "10", "M1", qty(1), money(0), d("2026-06-01")),    # net not > 0
        ("9004", "10", "M1", qty(1), money(7), d("2026-06-01")),    # excluded billing type
        ("9005", "10", "M1", qty(1), money(3), d("2026-05-01")),    # header in another load
    ], LINE)
    heads = spark.createDataFrame([
        ("9001", "F2", "USD", d("2026-04-20"), d("2026-05-01")),
        ("9001", "F2", "USD", d("2026-04-20"), d("2026-06-01")),
        ("9002", "F2", "USD", d("2026-05-03"), d("2026-06-01")),
        ("9003", "F2", "USD", d("2026-05-03"), d("2026-06-01")),
        ("9004", "S1", "USD", d("2026-05-03"), d("2026-06-01")),
        ("9005", "F2", "USD", d("2026-05-03"), d("2026-06-01")),
    ], HEAD)
    products = spark.createDataFrame([("M1", "G1"), ("M2", "G2")], "MATNR string, MATKL string")
    return lines, heads, products


def test_paired_counts_each_load(spark, tables):
    out = sales.monthly_sales(*tables, by_group=True, since="2026-01-01").collect()
    assert [(r.MATKL, r.YEARMONTH, r.QTY, r.NET_USD) for r in out] == [
        ("G1", "2026-04", qty(4), money(20)),     # double counted across two loads
        ("G2", "2026-05", qty(5), money(50)),
    ]


def test_global_latest_cuts_to_newest_load(spark, tables):
    out = sales.monthly_sales(*tables, by_group=True, snapshot="global_latest").collect()
    assert [(r.MATKL, r.YEARMONTH, r.QTY) for r in out] == [("G1", "2026-04", qty(2)), ("G2", "2026-05", qty(5))]
    lines, heads, products = tables
    # The newest load is taken over the whole line table before the group filter.
    only_old = lines.filter("MATNR = 'M1' OR FILE_DATE < DATE'2026-06-01'")
    assert sales.monthly_sales(only_old, heads, products, groups=["G2"], snapshot="global_latest").count() == 0
    with pytest.raises(ValueError):
        sales.monthly_sales(*tables, snapshot="latest")


def test_category_extract(spark, tables):
    mapping = spark.createDataFrame([("G1", "CarA"), ("G2", "CarA")], "MATKL string, CATEGORY string")
    monthly = sales.monthly_sales(*tables, by_group=True, exclude_types=None)
    out = sales.category_extract(monthly, mapping).collect()
    assert [(r.YEARMONTH, r.CATEGORY, r.QTY, r.NET_USD) for r in out] == [
        ("2026-04", "CarA", qty(4), money(20)),
        ("2026-05", "CarA", qty(6), money(57)),
    ]


def test_one_pass_category_sales_equals_two_steps(spark, tables):
    mapping = spark.createDataFrame([("G1", "CarA"), ("G2", "CarB")], "MATKL string, CATEGORY string")
    two = sales.category_extract(sales.monthly_sales(*tables, by_group=True, exclude_types=None), mapping)
    one = sales.category_sales(*tables, mapping, exclude_types=None)
    assert one.columns == two.columns
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    only_g2 = sales.category_sales(*tables, mapping, exclude_types=None, groups=["G2"]).collect()
    assert [(r.CATEGORY, r.QTY) for r in only_g2] == [("CarB", qty(5))]


def test_month_bounds_equal_a_filter_on_the_result(spark, tables):
    rows = lambda df: sorted(map(tuple, df.collect()))
    everything = sales.monthly_sales(*tables, by_group=True)
    for lo, hi in (("2026-04", "2026-04"), ("2026-04", "2026-05"), ("2026-05", "2026-12"), ("2026-05", "2026-04")):
        pushed = sales.monthly_sales(*tables, by_group=True, months=(lo, hi))
        assert rows(pushed) == rows(everything.filter(everything.YEARMONTH.between(lo, hi)))


def test_join_order_does_not_change_the_sums(tables):
    rows = lambda df: sorted(map(tuple, df.collect()))
    everything = sales.monthly_sales(*tables, by_group=True)
    chosen = sales.monthly_sales(*tables, by_group=True, groups=["G1"])
    assert rows(chosen) == rows(everything.filter("MATKL = 'G1'"))
    assert rows(sales.monthly_sales(*tables, by_group=True, groups=["G1", "G2"], salts=3)) == rows(everything)


def test_repeated_dimension_keys_are_found(spark, tables):
    lines, heads, products = tables
    twice = products.unionByName(products.filter("MATNR = 'M1'"))
    doubled = sales.monthly_sales(lines, heads, twice, groups=["G1"]).agg({"NET_USD": "sum"}).first()[0]
    assert doubled == 2 * sales.monthly_sales(lines, heads, products, groups=["G1"]).agg({"NET_USD": "sum"}).first()[0]
    with pytest.raises(ValueError, match="products: 1 repeated"):
        sales.monthly_sales(lines, heads, twice, check_keys=True)
    assert sales.monthly_sales(lines, heads, products, check_keys=True).count() > 0
    mapping = spark.createDataFrame([("G1", "A"), ("G1", "B"), ("G2", "A")], "MATKL string, CATEGORY string")
    monthly = sales.monthly_sales(lines, heads, products, by_group=True)
    with pytest.raises(ValueError, match="mapping: 1 repeated"):
        sales.category_extract(monthly, mapping, check_keys=True)
    with pytest.raises(ValueError, match="mapping: 1 repeated"):
        sales.category_sales(lines, heads, products, mapping, check_keys=True)
