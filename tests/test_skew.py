"""Hot keys: one key holding over a third of all rows.

Broadcasts are switched off so the joins shuffle; AQE must split the hot
partition (``skew=true`` on the join) and the results must stay exact.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from salesloom.operators import orders, versions

N = 30_000
HOT = "HOT"


@pytest.fixture()
def skewed(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _lines(spark):
    """Schedule lines: order HOT has 40% of all rows, all in one (key, load)
    group of copies plus older loads; the other orders are small."""
    base = spark.range(N).select(
        F.when(F.col("id") % 5 < 2, F.lit(HOT)).otherwise((F.col("id") % 997).cast("string")).alias("VBELN"),
        F.when(F.col("id") % 5 < 2, F.lit("10")).otherwise((F.col("id") % 7).cast("string")).alias("POSNR"),
        F.date_add(F.lit(dt.date(2026, 1, 1)), (F.col("id") % 3).cast("int")).alias("FILE_DATE"),
        F.date_add(F.lit(dt.date(2025, 12, 1)), (F.col("id") % 20).cast("int")).alias("EDATU"),
        (F.col("id") % 9 + 1).cast("decimal(18,3)").alias("WMENG"),
        F.lit(Decimal(0)).cast("decimal(18,3)").alias("LMENG"),
    )
    return base


def _plan(df) -> str:
    df.collect()
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return text.split("== Initial Plan ==")[0]


def test_latest_version_hot_key_is_split_and_exact(spark, skewed):
    lines = _lines(spark)
    got = versions.latest_version(lines, ["VBELN", "POSNR"], "FILE_DATE")
    assert "skew=true" in _plan(got)
    pdf = lines.toPandas()
    newest = pdf.groupby(["VBELN", "POSNR"])["FILE_DATE"].transform("max")
    want = pdf[pdf["FILE_DATE"] == newest]
    assert got.count() == len(want)
    hot = got.filter(F.col("VBELN") == HOT).count()
    assert hot == int((want["VBELN"] == HOT).sum()) > N // 10


def test_delayed_lines_hot_order_is_split_and_exact(spark, skewed):
    lines = _lines(spark)
    header = spark.createDataFrame(
        [(str(k), dt.date(2026, 1, 1), dt.date(2025, 11, 1), "ZOR", "C", "A", "B", Decimal("1.00"), "USD")
         for k in range(997)] + [(HOT, dt.date(2026, 1, 1), dt.date(2025, 11, 1), "ZOR", "C", "A", "B", Decimal("9.00"), "USD")],
        "VBELN string, FILE_DATE date, AUDAT date, AUART string, KUNNR string, "
        "LFSTK string, GBSTK string, NETWR decimal(18,2), WAERK string",
    )
    report = orders.delayed_lines(header, lines, as_of="2026-01-10", n=N)
    assert "skew=true" in _plan(report)
    pdf = lines.toPandas()
    newest = pdf.groupby(["VBELN", "POSNR"])["FILE_DATE"].transform("max")
    live = pdf[(pdf["FILE_DATE"] == newest) & (pdf["EDATU"] < dt.date(2026, 1, 10))
               & (pdf["WMENG"] > pdf["LMENG"]) & (pdf["WMENG"] > 0)]
    assert report.count() == len(live)


def test_monthly_sales_hot_invoice_is_split_and_exact(spark, skewed):
    from salesloom.operators import sales

    lines = spark.range(N).select(
        F.when(F.col("id") % 5 < 2, F.lit(HOT)).otherwise((F.col("id") % 991).cast("string")).alias("VBELN"),
        (F.col("id") % 13).cast("string").alias("POSNR"),
        (F.col("id") % 50).cast("string").alias("MATNR"),
        (F.col("id") % 4 + 1).cast("decimal(18,3)").alias("FKIMG"),
        (F.col("id") % 100 + 1).cast("decimal(18,2)").alias("NETWR"),
        F.lit(dt.date(2026, 6, 1)).alias("FILE_DATE"),
    )
    keys = [HOT] + [str(k) for k in range(991)]
    headers = spark.createDataFrame(
        [(k, "F2", "USD", dt.date(2026, 1 + i % 5, 3), dt.date(2026, 6, 1)) for i, k in enumerate(keys)],
        "VBELN string, FKART string, WAERK string, FKDAT date, FILE_DATE date",
    )
    products = spark.createDataFrame([(str(m), f"G{m % 3}") for m in range(50)], "MATNR string, MATKL string")
    out = sales.monthly_sales(lines, headers, products, by_group=True)
    assert "skew=true" in _plan(out)
    lp, hp, pp = lines.toPandas(), headers.toPandas(), products.toPandas()
    j = lp.merge(hp, on=["VBELN", "FILE_DATE"]).merge(pp, on="MATNR")
    j["YEARMONTH"] = j["FKDAT"].map(lambda x: x.strftime("%Y-%m"))
    want = j.groupby(["MATKL", "YEARMONTH"]).agg(QTY=("FKIMG", "sum"), NET_USD=("NETWR", "sum")).reset_index()
    got = {(r.MATKL, r.YEARMONTH): (r.QTY, r.NET_USD) for r in out.collect()}
    assert got == {(r.MATKL, r.YEARMONTH): (r.QTY, r.NET_USD) for r in want.itertuples()}


@pytest.fixture()
def no_aqe(spark):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _scans(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan") + plan.count("Range (") + plan.count("Scan ExistingRDD")


def test_salted_version_pick_without_aqe(spark, no_aqe):
    lines = _lines(spark)
    salted = versions.latest_version(lines, ["VBELN", "POSNR"], "FILE_DATE", salts=8)
    plain = versions.latest_version(lines, ["VBELN", "POSNR"], "FILE_DATE")
    plan = spark._jvm.PythonSQLUtils.explainString(salted._jdf.queryExecution(), "formatted")
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert _scans(salted) == _scans(plain) == 2
    got = sorted(map(tuple, salted.collect()))
    assert got == sorted(map(tuple, plain.collect()))
    pdf = lines.toPandas()
    newest = pdf.groupby(["VBELN", "POSNR"])["FILE_DATE"].transform("max")
    assert len(got) == int((pdf["FILE_DATE"] == newest).sum())
    assert salted.columns == lines.columns
    # The hot (key, load) group, copies and all, lies in several tasks.
    hot = salted.filter(F.col("VBELN") == HOT).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(hot) > 3 and max(r["count"] for r in hot) < sum(r["count"] for r in hot) / 2
    with pytest.raises(ValueError):
        versions.latest_version(lines, ["VBELN", "POSNR"], salts=0)


def test_salted_joins_without_aqe(spark, no_aqe):
    from salesloom.operators import sales

    lines = _lines(spark)
    header = spark.createDataFrame(
        [(str(k), dt.date(2026, 1, 1), dt.date(2025, 11, 1), "ZOR", "C", "A", "B", Decimal("1.00"), "USD")
         for k in range(997)] + [(HOT, dt.date(2026, 1, 1), dt.date(2025, 11, 1), "ZOR", "C", "A", "B", Decimal("9.00"), "USD")],
        "VBELN string, FILE_DATE date, AUDAT date, AUART string, KUNNR string, "
        "LFSTK string, GBSTK string, NETWR decimal(18,2), WAERK string",
    )
    plain = orders.delayed_lines(header, lines, as_of="2026-01-10", n=N)
    split = orders.delayed_lines(header, lines, as_of="2026-01-10", n=N, salts=4)
    plan = spark._jvm.PythonSQLUtils.explainString(split._jdf.queryExecution(), "formatted")
    assert "Broadcast" not in plan and _scans(split) == _scans(plain)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, plain.collect()))

    inv = spark.range(N).select(
        F.when(F.col("id") % 5 < 2, F.lit(HOT)).otherwise((F.col("id") % 991).cast("string")).alias("VBELN"),
        (F.col("id") % 13).cast("string").alias("POSNR"),
        F.when(F.col("id") % 3 == 0, F.lit("7")).otherwise((F.col("id") % 50).cast("string")).alias("MATNR"),
        (F.col("id") % 4 + 1).cast("decimal(18,3)").alias("FKIMG"),
        (F.col("id") % 100 + 1).cast("decimal(18,2)").alias("NETWR"),
        F.lit(dt.date(2026, 6, 1)).alias("FILE_DATE"),
    )
    heads = spark.createDataFrame(
        [(k, "F2", "USD", dt.date(2026, 1 + i % 5, 3), dt.date(2026, 6, 1))
         for i, k in enumerate([HOT] + [str(k) for k in range(991)])],
        "VBELN string, FKART string, WAERK string, FKDAT date, FILE_DATE date",
    )
    products = spark.createDataFrame([(str(m), f"G{m % 3}") for m in range(50)], "MATNR string, MATKL string")
    a = sales.monthly_sales(inv, heads, products, by_group=True)
    b = sales.monthly_sales(inv, heads, products, by_group=True, salts=4)
    assert _scans(b) == _scans(a)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
