"""Monthly invoiced sales (K10) and the month x category extract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions.dates import date_value, month_key
from ..functions.ordering import ascending
from .joins import key_filter, salted_join
from .versions import require_unique

SNAPSHOT_MODES = ("paired", "global_latest")
JOIN_ORDERS = ("fixed", "size")


def monthly_sales(
    lines: DataFrame,
    headers: DataFrame,
    products: DataFrame,
    by_group: bool = False,
    groups: Sequence[str] | None = None,
    snapshot: str = "paired",
    exclude_types: Sequence[str] | None = D.EXCLUDED_BILLING_TYPES,
    currency: str | None = D.SALES_CURRENCY,
    since=None,
    min_net=0,
    group_col: str = "MATKL",
    salts: int | None = None,
    months: tuple[str, str] | None = None,
    check_keys: bool = False,
    newest=None,
    join_order: str = "fixed",
    filter_bits: int | None = None,
) -> DataFrame:
    """Invoiced quantity and net amount per billing month.

    Invoice lines join their header on document number *and* load date, then
    the product for its group. Kept: billing type not in ``exclude_types``,
    line net amount > ``min_net``, header currency ``currency``, billing date
    on or after ``since``, product group in ``groups``.

    ``snapshot``:
      * ``"paired"`` keeps every load; a line present in several loads is
        counted once per load (``duplicate_keys`` finds those).
      * ``"global_latest"`` keeps only the newest load date of the whole line
        table, taken before any other filter, so a group missing from that
        load gets no rows. It runs as a scalar subquery, which Spark pushes to
        the line scan (and prunes load-date partitions with); with ``newest``,
        the date that ``sources.snapshots.newest_load`` gives for a stored
        table, no row is read to find it.

    Result: ``[group_col,] YEARMONTH, QTY, NET_USD`` ordered by month, then
    group; ``groups`` always filters ``MATKL``, ``group_col`` (default
    ``MATKL``) is the product column the sums are grouped by.
    ``months`` keeps an inclusive range of billing months (``yyyy-MM``), as
    date bounds that reach the header scan; an empty range gives no rows.
    ``salts`` spreads hot keys of the header and product joins (see
    ``operators.joins``). ``check_keys`` fails if a product is listed twice.

    With ``groups`` the chosen products are joined before the header, so that
    only lines of those groups are shuffled by document; without, the header
    (which drops lines too) comes first. ``join_order="size"`` counts both
    dimensions, whole and as filtered (eager: four counts), and joins the one
    first that keeps the smaller share of its rows: the lines that are left
    are what the second join shuffles. ``filter_bits`` filters the lines by
    the keys of both where they are scanned (``joins.key_filter``): what is
    left of them is all that either join shuffles, in any order.
    The product side is joined by key; AQE broadcasts it only when its
    run-time size is under the broadcast threshold.
    """
    if join_order not in JOIN_ORDERS:
        raise ValueError(f"join_order must be one of {JOIN_ORDERS}, not {join_order!r}")
    if snapshot not in SNAPSHOT_MODES:
        raise ValueError(f"snapshot must be one of {SNAPSHOT_MODES}, not {snapshot!r}")
    if snapshot == "global_latest":
        day = lines.select(F.max("FILE_DATE")).scalar() if newest is None else date_value(newest)
        lines = lines.filter(F.col("FILE_DATE") == day)
    lines = lines.filter(F.col("NETWR") > min_net).select(
        "VBELN", "FILE_DATE", "MATNR", "FKIMG", "NETWR"
    )
    whole = headers, products
    if exclude_types is not None:
        headers = headers.filter(~F.col("FKART").isin(list(exclude_types)))
    if currency is not None:
        headers = headers.filter(F.col("WAERK") == currency)
    if since is not None:
        headers = headers.filter(F.col("FKDAT") >= date_value(since))
    if months is not None:
        lo, hi = (F.to_date(F.lit(f"{m}-01")) for m in months)
        headers = headers.filter((F.col("FKDAT") >= lo) & (F.col("FKDAT") < F.add_months(hi, 1)))
    headers = headers.select("VBELN", "FILE_DATE", month_key("FKDAT").alias("YEARMONTH"))
    if check_keys:
        require_unique(products, "MATNR", "products")
    if groups is not None:
        products = products.filter(F.col("MATKL").isin(list(groups)))
    products = products.select("MATNR", group_col)

    steps = [(headers, ["VBELN", "FILE_DATE"]), (products, ["MATNR"])]
    if join_order == "size":
        kept = [dim.count() / max(1, all_rows.count()) for (dim, _), all_rows in zip(steps, whole)]
        products_first = kept[1] < kept[0]
    else:
        products_first = groups is not None
    joined = lines
    if filter_bits is not None:
        for dim, on in steps:
            joined = key_filter(joined, dim.select(*on), on, filter_bits)
    for dim, on in reversed(steps) if products_first else steps:
        joined = salted_join(joined, dim, on, "inner", salts)
    keys = [group_col, "YEARMONTH"] if by_group else ["YEARMONTH"]
    return (
        joined.groupBy(*keys)
        .agg(
            F.sum("FKIMG").cast("decimal(38,3)").alias("QTY"),
            F.sum("NETWR").cast("decimal(38,2)").alias("NET_USD"),
        )
        .orderBy(*ascending("YEARMONTH", *([group_col] if by_group else [])))
    )


def category_extract(monthly_by_group: DataFrame, mapping: DataFrame, check_keys: bool = False) -> DataFrame:
    """Monthly group sums rolled up to categories.

    ``mapping`` is ``MATKL -> CATEGORY``; its key must be unique or sums fan
    out (``check_keys`` fails then). Groups without a
    category are left out. Result: ``YEARMONTH, CATEGORY, QTY, NET_USD``
    ordered by month, then category - the extract's shape and order.
    """
    if check_keys:
        require_unique(mapping, "MATKL", "mapping")
    return (
        monthly_by_group.join(mapping.select("MATKL", "CATEGORY"), on="MATKL", how="inner")
        .groupBy("YEARMONTH", "CATEGORY")
        .agg(
            F.sum("QTY").cast("decimal(38,3)").alias("QTY"),
            F.sum("NET_USD").cast("decimal(38,2)").alias("NET_USD"),
        )
        .orderBy(*ascending("YEARMONTH", "CATEGORY"))
    )


def category_sales(
    lines: DataFrame,
    headers: DataFrame,
    products: DataFrame,
    mapping: DataFrame,
    **filters,
) -> DataFrame:
    """K13 in one pass: the same extract as ``category_extract(monthly_sales(
    ..., by_group=True), mapping)``, with products mapped to their category
    before the single aggregation (sums are exact, the mapping is many-to-one).

    The mapping join is dimension x dimension (products x groups), so the
    fact rows see one more column and the plan one aggregation fewer.
    ``filters`` are ``monthly_sales`` keyword arguments.
    """
    if filters.get("check_keys"):
        require_unique(mapping, "MATKL", "mapping")
    mapped = products.join(mapping.select("MATKL", "CATEGORY"), on="MATKL", how="inner")
    return monthly_sales(
        lines, headers, mapped, by_group=True, group_col="CATEGORY", **filters
    ).select("YEARMONTH", "CATEGORY", "QTY", "NET_USD")
