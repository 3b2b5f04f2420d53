"""Views of the TPC-H-like test tables in the sales-order data model.

The jobs are written against the order/invoice/product model (order header
VBAK, schedule line VBEP, invoice header VBRK, invoice line VBRP, product
MARA, product text MAKT). These functions are plain projections that rename
and type the test tables into that model, so the same job code runs on both.
Money becomes ``decimal(18,2)``, quantities ``decimal(18,3)`` and timestamps
dates, once, at the source. Projections are free: Catalyst still prunes the
parquet columns and pushes filters through the renames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
QUANTITY = "decimal(18,3)"


def _day(name: str) -> Column:
    return F.to_date(F.col(name))


def _load_date(name: str, grain: str) -> Column:
    """Load (version) date at daily, monthly or yearly grain."""
    if grain == "day":
        return _day(name)
    if grain in ("month", "year"):
        return F.trunc(F.col(name), grain)
    raise ValueError(f"grain must be 'day', 'month' or 'year', not {grain!r}")


def order_header(orders: DataFrame, key: str = "o_custkey") -> DataFrame:
    """VBAK from ``orders``.

    ``key`` picks the business key: ``o_custkey`` repeats with different
    order dates, so each customer acts as one order with several loads (the
    versioned case); ``o_orderkey`` is unique (one load per order).
    """
    return orders.select(
        F.col(key).alias("VBELN"),
        _day("o_orderdate").alias("FILE_DATE"),
        _day("o_orderdate").alias("AUDAT"),
        F.col("o_orderkey").cast("string").alias("AUART"),
        F.col("o_custkey").alias("KUNNR"),
        F.col("o_orderstatus").alias("LFSTK"),
        F.col("o_orderpriority").alias("GBSTK"),
        F.col("o_totalprice").cast(MONEY).alias("NETWR"),
        F.col("o_orderpriority").alias("WAERK"),
    )


def schedule_lines(lineitem: DataFrame) -> DataFrame:
    """VBEP from ``lineitem``: (order, line) repeats across ship dates.

    Delivered quantity is ``100 * l_discount`` so that some lines are still
    open (ordered > delivered).
    """
    return lineitem.select(
        F.col("l_orderkey").alias("VBELN"),
        F.col("l_linenumber").alias("POSNR"),
        _day("l_shipdate").alias("FILE_DATE"),
        _day("l_shipdate").alias("EDATU"),
        F.col("l_quantity").cast(QUANTITY).alias("WMENG"),
        (F.col("l_discount") * 100).cast(QUANTITY).alias("LMENG"),
    )


def invoice_lines(lineitem: DataFrame, grain: str = "day") -> DataFrame:
    """VBRP from ``lineitem``; the load date is the ship date (or its month/year)."""
    return lineitem.select(
        F.col("l_orderkey").alias("VBELN"),
        F.col("l_linenumber").alias("POSNR"),
        F.col("l_partkey").alias("MATNR"),
        F.col("l_quantity").cast(QUANTITY).alias("FKIMG"),
        F.col("l_extendedprice").cast(MONEY).alias("NETWR"),
        _load_date("l_shipdate", grain).alias("FILE_DATE"),
    )


def invoice_headers(orders: DataFrame, grain: str = "day") -> DataFrame:
    """VBRK from ``orders``; billing type = priority, currency = status."""
    return orders.select(
        F.col("o_orderkey").alias("VBELN"),
        F.col("o_orderpriority").alias("FKART"),
        F.col("o_orderstatus").alias("WAERK"),
        _day("o_orderdate").alias("FKDAT"),
        _load_date("o_orderdate", grain).alias("FILE_DATE"),
    )


def products(part: DataFrame, group: str = "p_type") -> DataFrame:
    """MARA from ``part``; the material group is ``p_type`` or ``p_brand``."""
    return part.select(F.col("p_partkey").alias("MATNR"), F.col(group).alias("MATKL"))


def product_texts(part: DataFrame) -> DataFrame:
    """MAKT from ``part`` (one text per product, no language column)."""
    return part.select(F.col("p_partkey").alias("MATNR"), F.col("p_name").alias("MAKTX"))


def document_products(documents: DataFrame) -> DataFrame:
    """MARA from ``documents``: product = document, group = source."""
    return documents.select(F.col("doc_id").alias("MATNR"), F.col("source").alias("MATKL"))


def document_texts(documents: DataFrame) -> DataFrame:
    """MAKT from ``documents``: the whole text, language = ``lang``."""
    return documents.select(
        F.col("doc_id").alias("MATNR"),
        F.col("lang").alias("SPRAS"),
        F.col("text").alias("MAKTX"),
    )


def category_map(part: DataFrame) -> DataFrame:
    """Material group -> category, derived from the part types.

    The real mapping is an input table; here each ``p_type`` maps to its
    capitalised name (``PROMO`` -> ``Promo``).
    """
    return (
        part.select(F.col("p_type").alias("MATKL"))
        .distinct()
        .select("MATKL", F.initcap("MATKL").alias("CATEGORY"))
    )


def category_labels(part: DataFrame) -> DataFrame:
    """Category -> display label, derived from the part types
    (``Promo`` -> ``Promo (PROMO)``)."""
    return (
        part.select(F.col("p_type").alias("MATKL"))
        .distinct()
        .select(
            F.initcap("MATKL").alias("CATEGORY"),
            F.concat(F.initcap("MATKL"), F.lit(" ("), F.col("MATKL"), F.lit(")")).alias("LABEL"),
        )
    )
