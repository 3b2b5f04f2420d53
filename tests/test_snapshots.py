"""Stored tables: newest load from folder names, bucketed catalog tables, the default schema,
CSV with a byte-order mark, the extract by month, derived tables."""

from __future__ import annotations

import datetime as dt
import os
import re
from decimal import Decimal
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from salesloom.operators import dashboard, orders, sales, versions
from salesloom.plans import registry, stored_jobs
from salesloom.sources import extract, snapshots, standins
from salesloom.sources.stored import new_folder
from salesloom.sources.tables import load_table, write_versioned
from tests.conftest import HEADER_SCHEMA, LINE_SCHEMA, d, money, qty

SF = "/root/testdata/sf0.001"


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


# --- newest load ----------------------------------------------------------------------------


def test_newest_load_is_the_newest_with_rows(spark, tmp_path):
    path = str(tmp_path / "vbrp")
    rows = [("A", d("2026-01-05")), ("B", d("2026-01-07")), ("C", None)]
    write_versioned(spark.createDataFrame(rows, "VBELN string, FILE_DATE date"), path)
    assert snapshots.newest_load(spark, path) == dt.date(2026, 1, 7)
    # a later load that left a file without rows, as a scalar MAX sees it too
    spark.createDataFrame([], "VBELN string").coalesce(1).write.parquet(f"{path}/FILE_DATE=2026-01-09")
    assert snapshots.newest_load(spark, path) == spark.read.parquet(path).agg(F.max("FILE_DATE")).first()[0] == dt.date(2026, 1, 7)


def test_newest_load_of_nothing(spark, tmp_path):
    plain = str(tmp_path / "plain")
    spark.createDataFrame([("A", d("2026-01-05"))], "VBELN string, FILE_DATE date").write.parquet(plain)
    with pytest.raises(ValueError):
        snapshots.newest_load(spark, plain)
    nulls = str(tmp_path / "nulls")
    write_versioned(spark.createDataFrame([("A", None)], "VBELN string, FILE_DATE date"), nulls)
    assert snapshots.newest_load(spark, nulls) is None


def test_no_row_is_read_for_the_newest_load(spark):
    path = stored_jobs.stored_lines(spark, SF)
    newest = snapshots.newest_load(spark, path)
    lines = spark.read.parquet(path)
    heads = standins.invoice_headers(load_table(spark, "orders", base=SF), grain="year")
    products = standins.products(load_table(spark, "part", base=SF))
    args = dict(snapshot="global_latest", exclude_types=None, currency=None)
    a = sales.monthly_sales(lines, heads, products, newest=newest, **args)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, sales.monthly_sales(lines, heads, products, **args).collect()))
    plan = executed(a)
    assert "Subquery" not in plan
    assert re.search(rf"PartitionFilters: \[isnotnull\(FILE_DATE#\d+\), \(FILE_DATE#\d+ = {newest}", plan)
    # the look at a load's files reads no column
    look = lines.filter(F.col("FILE_DATE") == F.lit(newest)).select("FILE_DATE").limit(1)
    assert "ReadSchema: struct<>" in look._jdf.queryExecution().executedPlan().toString()


# --- buckets and schemas --------------------------------------------------------------------


def test_bucketed_tables_need_no_exchange(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = registry.jobs()["k3_delayed_lines_stored"](spark, SF)
        plan = executed(df)
        assert "Exchange" not in plan and plan.count("FileScan parquet") == 2 and plan.count("Bucketed: true") == 2
        assert [tuple(r) for r in df.collect()] == [tuple(r) for r in registry.jobs()["k3_delayed_lines"](spark, SF).collect()]
        schema = stored_jobs.stored_orders(spark, SF)
        for table, keys in (("VBAK", ["VBELN"]), ("VBEP", ["VBELN", "POSNR"])):
            assert "Exchange" not in executed(versions.latest_version(spark.table(f"{schema}.{table}"), keys, colocated=True))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_colocated_pick_gives_the_same_rows(spark):
    rows = [("A", d("2026-01-01"), 1), ("A", d("2026-01-02"), 2), ("A", d("2026-01-02"), 3), (None, d("2026-01-03"), 4), ("B", None, 5), ("C", None, 6), ("C", d("2026-01-01"), 7)]
    df = spark.createDataFrame(rows, "VBELN string, FILE_DATE date, n int")
    for since in (None, "2026-01-02"):
        plain = sorted(map(tuple, versions.latest_version(df, since=since).collect()), key=str)
        assert sorted(map(tuple, versions.latest_version(df, since=since, colocated=True).collect()), key=str) == plain


def test_colocated_report_on_hand_made_rows(spark):
    header = spark.createDataFrame([("H1", d("2026-01-01"), d("2026-01-01"), "A", "C", "A", "A", money(1), "EUR"), ("H1", d("2026-01-02"), d("2026-01-01"), "A", "C", "A", "C", money(1), "EUR"), ("H2", d("2026-01-01"), d("2026-01-01"), "A", "C", "A", "A", money(2), "EUR")], HEADER_SCHEMA)
    lines = spark.createDataFrame([(h, "1", d("2026-01-01"), d("2026-01-03"), qty(5), qty(1)) for h in ("H1", "H2", "H3")], LINE_SCHEMA)
    a, b = (orders.delayed_lines(header, lines, as_of="2026-02-01", open_statuses=("A",), closed_status="C", colocated=c).collect() for c in (True, False))
    assert a == b and [r.VBELN for r in a] == ["H2"]


def test_default_schema_is_given_back(spark):
    schema = snapshots.create_schema(spark)
    snapshots.write_bucketed(spark.range(50).withColumnRenamed("id", "VBELN"), "T1", ["VBELN"], 4, schema)
    before = spark.catalog.currentDatabase()
    with snapshots.default_schema(spark, schema):
        df = load_table(spark, "T1")
    assert spark.catalog.currentDatabase() == before and df.count() == 50
    with pytest.raises(RuntimeError), snapshots.default_schema(spark, schema):
        raise RuntimeError
    assert spark.catalog.currentDatabase() == before


def test_derived_is_built_once_until_the_files_change(spark, tmp_path):
    path, built = str(tmp_path / "in"), []
    spark.range(3).write.parquet(path)
    get = lambda: snapshots.derived("test", [spark.read.parquet(path)], built.append)
    assert get() == get() and len(built) == 1
    spark.range(2).write.mode("append").parquet(path)
    assert get() == built[1] != built[0]


# --- the extract ----------------------------------------------------------------------------

EXTRACT = [("2025-01", "A", Decimal("1.500"), Decimal("-2.50")), ("2025-02", "Ä, \"x\"", Decimal("0.001"), Decimal("99999999999.99")), ("2025-02", "B", None, Decimal("0.00")), ("2025-03", "A", Decimal("3"), Decimal("3"))]


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame(EXTRACT, extract.EXTRACT_SCHEMA)
    extract.write_extract(df, path, bom=True)
    parts = [open(f"{path}/{f}", "rb").read() for f in sorted(os.listdir(path)) if f.endswith(".csv")]
    assert parts and all(p.startswith(b"\xef\xbb\xbfYEARMONTH,CATEGORY,QTY,NET_USD\r\n") for p in parts)
    assert all(p.count(b"\n") == p.count(b"\r\n") for p in parts)
    assert sorted(map(tuple, extract.read_extract(spark, path).collect()), key=str) == sorted(EXTRACT, key=str)


def test_stored_extract_reads_the_months_of_a_range(spark):
    path = new_folder(spark, "test-extract")
    extract.write_extract_table(spark.createDataFrame(EXTRACT, extract.EXTRACT_SCHEMA), path)
    table = extract.read_extract_table(spark, path)
    assert dict(table.dtypes)["YEARMONTH"] == "string" and sorted(map(tuple, table.collect()), key=str) == sorted(EXTRACT, key=str)
    assert sorted(f for f in os.listdir(urlparse(path).path) if "=" in f) == ["YEARMONTH=2025-01", "YEARMONTH=2025-02", "YEARMONTH=2025-03"]
    for df in (dashboard.slice_kpis(table, "2025-02", "2025-03", ["A"]), dashboard.pivot_with_totals(table, "2025-02", "2025-03", ["A"]), dashboard.dense_series(table, "2025-02", "2025-03", ["A"])):
        assert re.search(r"PartitionFilters: \[isnotnull\(YEARMONTH#\d+\), \(YEARMONTH#\d+ >= 2025-02\), \(YEARMONTH#\d+ <= 2025-03\)\]", executed(df))


def test_ten_reads_of_one_build(spark):
    builds = len(snapshots._BUILT)
    jobs = [j for n, j in registry.jobs().items() if n.endswith("_stored") and n[:3] in ("k13", "k14", "k15", "k16", "k17")]
    for job in jobs:
        assert "lineitem" not in executed(job(spark, SF))
    assert len(jobs) == 7 and len(snapshots._BUILT) <= builds + 1


def test_preview_does_not_shuffle_the_table(spark):
    plan = executed(registry.jobs()["k18_preview"](spark, SF))
    assert "hashpartitioning(doc_id" not in plan and "xxhash64" not in plan
