"""Sources and sinks: named tables, SQL text with parameters, partitioned
snapshot storage with pruning."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from salesloom.operators import sales, versions
from salesloom.sources import standins
from salesloom.sources.tables import column_names, load_table, preview, run_sql, write_versioned

SF = "/root/testdata/sf0.001"


def test_load_table_and_sql(spark):
    orders = load_table(spark, "orders", base=SF)
    assert "o_orderkey" in column_names(orders)
    out = run_sql(
        spark,
        "SELECT o_orderstatus, COUNT(*) AS n FROM o WHERE o_orderdate >= :since GROUP BY o_orderstatus",
        views={"o": orders},
        args={"since": "1998-01-01"},
    )
    want = orders.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).count()
    assert sum(r.n for r in out.collect()) == want
    assert preview(orders, 3).count() == 3


def test_partitioned_snapshots_prune(spark, tmp_path):
    lines = standins.invoice_lines(load_table(spark, "lineitem", base=SF), grain="year")
    path = str(tmp_path / "vbrp")
    write_versioned(lines, path)
    stored = spark.read.parquet(path)
    assert stored.count() == lines.count()
    newest = stored.select(F.max("FILE_DATE")).scalar()
    cut = stored.filter(F.col("FILE_DATE") == newest)
    plan = spark._jvm.PythonSQLUtils.explainString(cut._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[isnotnull\(FILE_DATE#\d+\), \(FILE_DATE#\d+ = Subquery", plan)
    floor = versions.latest_version(stored, ["VBELN", "POSNR"], since="2000-01-01")
    plan = spark._jvm.PythonSQLUtils.explainString(floor._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[isnotnull\(FILE_DATE#\d+\), \(FILE_DATE#\d+ >= 2000-01-01\)", plan)
    heads = standins.invoice_headers(load_table(spark, "orders", base=SF), grain="year")
    products = standins.products(load_table(spark, "part", base=SF))
    a = sales.monthly_sales(stored, heads, products, snapshot="global_latest", exclude_types=None, currency=None)
    b = sales.monthly_sales(lines, heads, products, snapshot="global_latest", exclude_types=None, currency=None)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_conform_casts_an_all_text_extract(spark):
    from decimal import Decimal

    import pytest

    from salesloom.sources import model

    raw = spark.createDataFrame(
        [("0000001", "2026-01-05", "ZOR", "C1", "A", "B", "1234.50", "USD", "2026-01-06", "extra")],
        "VBELN string, AUDAT string, AUART string, KUNNR string, LFSTK string, GBSTK string, "
        "NETWR string, WAERK string, FILE_DATE string, JUNK string",
    )
    vbak = model.conform(raw, "VBAK")
    assert vbak.schema == model.schema("VBAK")
    row = vbak.first()
    assert (row.VBELN, row.NETWR, str(row.FILE_DATE)) == ("0000001", Decimal("1234.50"), "2026-01-06")
    with pytest.raises(ValueError):
        model.conform(raw.drop("NETWR"), "VBAK")


def test_snapshot_sink_writes_few_files_per_load(spark, tmp_path):
    lines = standins.invoice_lines(load_table(spark, "lineitem", base=SF), grain="year").repartition(12)
    path = tmp_path / "vbrp"
    write_versioned(lines, str(path))
    loads = sorted(p.name for p in path.glob("FILE_DATE=*"))
    assert loads == sorted(f"FILE_DATE={r.FILE_DATE}" for r in lines.select("FILE_DATE").distinct().collect())
    # 12 tasks would each write a file per load without the clustering
    assert all(len(list((path / name).glob("*.parquet"))) == 1 for name in loads)


def test_a_table_that_grows_is_read_anew(spark, tmp_path):
    from salesloom.plans.standin_jobs import _t

    path = tmp_path / "sf"
    spark.range(5).write.parquet(str(path / "grows.parquet"))
    assert _t(spark, str(path), "grows").count() == 5
    spark.range(5).write.mode("append").parquet(str(path / "grows.parquet"))
    assert _t(spark, str(path), "grows").count() == 10
