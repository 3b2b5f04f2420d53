"""Jobs over stored tables: a partitioned line snapshot, bucketed catalog tables
read by bare names, the extract as CSV and as a month-partitioned table.

What is stored is worked out from the test tables, once per application and
state of their files (``sources.snapshots.derived``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dashboard as dash
from ..operators import orders as ord_ops
from ..operators import sales
from ..operators.catalog import column_counts
from ..sources import extract as ext
from ..sources import standins
from ..sources.snapshots import create_schema, default_schema, derived, newest_load, write_bucketed
from ..sources.stored import new_folder
from ..sources.tables import load_table, run_sql, write_versioned
from . import standin_jobs as sj
from .registry import oracle_of, register

_t = sj._t

#: Buckets of the stored order tables.
BUCKETS = 16


# ---------------------------------------------------------------------------
# A9/F15 from metadata: the newest load of a stored snapshot
# ---------------------------------------------------------------------------
def stored_lines(spark: SparkSession, sf_dir: str) -> str:
    """The invoice lines as a snapshot table partitioned by load date."""
    source = _t(spark, sf_dir, "lineitem")
    return derived("vbrp", [source], lambda path: write_versioned(standins.invoice_lines(source, sj.SALES_GRAIN), path))


@register("k10_monthly_sales_stored", oracle=sj._sql_monthly(sj.SALES_GROUPS, True, True))
def k10_monthly_sales_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of the newest load, found in the names of the table's folders."""
    path = stored_lines(spark, sf_dir)
    return sales.monthly_sales(
        spark.read.parquet(path),
        standins.invoice_headers(_t(spark, sf_dir, "orders"), sj.SALES_GRAIN),
        standins.products(_t(spark, sf_dir, "part")),
        by_group=True, groups=sj.SALES_GROUPS, snapshot="global_latest", newest=newest_load(spark, path),
        exclude_types=sj.EXCLUDED_TYPES, currency=sj.SALES_CURRENCY, since=sj.SALES_SINCE,
    )


# ---------------------------------------------------------------------------
# S1/S3/S4 catalog tables by bare names; J1-J3 on tables in common buckets
# ---------------------------------------------------------------------------
def stored_orders(spark: SparkSession, sf_dir: str) -> str:
    """A schema with VBAK and VBEP, both in buckets of the order key."""
    orders, lineitem = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")

    def build(schema: str) -> None:
        write_bucketed(standins.order_header(orders, key="o_orderkey"), "VBAK", ["VBELN"], BUCKETS, schema)
        write_bucketed(standins.schedule_lines(lineitem), "VBEP", ["VBELN"], BUCKETS, schema)

    return derived("orders", [orders, lineitem], build, create_schema)


@register("k3_delayed_lines_stored", oracle=sj.SQL_K3)
def k3_delayed_lines_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 on bucketed tables: version picks and header join without an exchange."""
    with default_schema(spark, stored_orders(spark, sf_dir)):
        header, lines = load_table(spark, "VBAK"), load_table(spark, "VBEP")
    return ord_ops.delayed_lines(
        header, lines, as_of=sj.DELAY_AS_OF, since=sj.LINES_SINCE, n=20,
        open_statuses=sj.OPEN_STATUSES, closed_status=sj.CLOSED_STATUS, colocated=True,
    )


@register(
    "s3_default_schema",
    oracle="""
SELECT o_orderstatus AS LFSTK, count(DISTINCT o_orderkey) AS ORDERS, count(l_linenumber) AS LINES
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def s3_default_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL text over unqualified names of the default schema."""
    with default_schema(spark, stored_orders(spark, sf_dir)):
        return run_sql(
            spark,
            "SELECT LFSTK, COUNT(DISTINCT h.VBELN) AS ORDERS, COUNT(l.POSNR) AS LINES "
            "FROM VBAK h LEFT JOIN VBEP l ON l.VBELN = h.VBELN GROUP BY LFSTK",
        )


#: Column of the model -> column of the test table.
_S4_COLUMNS = {
    "VBELN": "o_orderkey", "FILE_DATE": "o_orderdate", "AUDAT": "o_orderdate", "AUART": "o_orderkey", "KUNNR": "o_custkey",
    "LFSTK": "o_orderstatus", "GBSTK": "o_orderpriority", "NETWR": "o_totalprice", "WAERK": "o_orderpriority",
}


@register(
    "s4_column_list",
    oracle=" UNION ALL ".join(
        f"SELECT {i} AS POS, '{name}' AS COLUMN_NAME, count({raw}) AS FILLED FROM orders"
        for i, (name, raw) in enumerate(_S4_COLUMNS.items(), 1)
    ),
)
def s4_column_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a catalog table in order, with the rows that fill them."""
    with default_schema(spark, stored_orders(spark, sf_dir)):
        return column_counts(load_table(spark, "VBAK"))


# ---------------------------------------------------------------------------
# S6/S7 the extract as CSV; K13 -> K14-K17 the extract stored by month
# ---------------------------------------------------------------------------
@register("s7_csv_round_trip", oracle=sj.SQL_EXTRACT_CTES + "\nSELECT YEARMONTH, CATEGORY, QTY, NET_USD FROM extract")
def s7_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extract written as CSV (byte-order mark, CRLF) and read back."""
    path = new_folder(spark, "extract-csv")
    ext.write_extract(sj._extract(spark, sf_dir), path, bom=True)
    return ext.read_extract(spark, path).select(
        "YEARMONTH", "CATEGORY", F.col("QTY").cast("decimal(38,3)").alias("QTY"), F.col("NET_USD").cast("decimal(38,2)").alias("NET_USD")
    )


def stored_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extract, from its table; the facts are read to build it once."""
    inputs = [_t(spark, sf_dir, t) for t in ("lineitem", "orders", "part")]
    path = derived("extract", inputs, lambda path: ext.write_extract_table(sj._extract(spark, sf_dir), path))
    return ext.read_extract_table(spark, path)


#: Dashboard jobs over the stored extract: name, the job over the facts whose
#: SQL it shares, what it shows.
_STORED = {
    "k13_category_extract_stored": ("k13_category_sales", lambda e: e),
    "k14_slice_kpis_stored": ("k14_slice_kpis", lambda e: dash.slice_kpis(e, sj.SLICE_LO, sj.SLICE_HI, sj.SLICE_CATS)),
    "k15_dense_series_stored": ("k15_dense_series", lambda e: dash.dense_series(e, sj.SLICE_LO, sj.SLICE_HI, sj.SERIES_CATS, "amt")),
    "k15_dense_series_qty_stored": ("k15_dense_series_qty", lambda e: dash.dense_series(e, sj.SLICE_LO, sj.SLICE_HI, sj.SERIES_CATS, "qty")),
    "k16_pivot_totals_stored": ("k16_pivot_totals", lambda e: dash.pivot_with_totals(e, sj.SLICE_LO, sj.SLICE_HI, sj.PIVOT_CATS, "amt")),
    "k16_pivot_totals_qty_stored": ("k16_pivot_totals_qty", lambda e: dash.pivot_with_totals(e, sj.SLICE_LO, sj.SLICE_HI, sj.PIVOT_CATS, "qty")),
    "k17_default_range_stored": ("k17_default_range", dash.default_range),
}


def _register_stored(name: str, like: str, show) -> None:
    @register(name, oracle=oracle_of(like))
    def job(spark: SparkSession, sf_dir: str) -> DataFrame:
        return show(stored_extract(spark, sf_dir))


for _name, (_like, _show) in _STORED.items():
    _register_stored(_name, _like, _show)
