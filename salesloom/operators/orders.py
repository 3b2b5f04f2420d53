"""Sales-order reports: largest open orders (K2), overdue schedule lines (K3)
and per-currency subtotals of a report (K4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions.dates import date_value, day_diff
from ..functions.ordering import ascending, descending
from .joins import key_filter, salted_join
from .versions import latest_version

# The columns of the two reports, in their order.
HEADER_COLUMNS = ("VBELN", "AUDAT", "AUART", "KUNNR", "LFSTK", "GBSTK", "NETWR", "WAERK")
DELAY_COLUMNS = (
    "VBELN", "POSNR", "AUDAT", "EDATU", "WMENG", "REMAIN_QTY", "DELAY_DAYS",
    "KUNNR", "NETWR", "WAERK", "AUART",
)


def open_headers(
    header: DataFrame,
    since=None,
    open_statuses: Sequence[str] = D.OPEN_DELIVERY_STATUSES,
    closed_status: str = D.CLOSED_OVERALL_STATUS,
    key: str = "VBELN",
    version: str = "FILE_DATE",
    delivery_status: str = "LFSTK",
    overall_status: str = "GBSTK",
    salts: int | None = None,
    colocated: bool = False,
) -> DataFrame:
    """Newest header version per order, kept when it is still open.

    Open means delivery status in ``open_statuses`` and overall status not
    ``closed_status`` (a NULL status is not open). The status test runs after
    the version pick.
    """
    newest = latest_version(header, key, version, since, salts=salts, colocated=colocated)
    return newest.filter(
        F.col(delivery_status).isin(list(open_statuses))
        & (F.col(overall_status) != closed_status)
    )


def open_orders(
    header: DataFrame,
    as_of=None,
    since=None,
    created_since=None,
    n: int = D.OPEN_ORDER_ROWS,
    open_statuses: Sequence[str] = D.OPEN_DELIVERY_STATUSES,
    closed_status: str = D.CLOSED_OVERALL_STATUS,
    key: str = "VBELN",
    version: str = "FILE_DATE",
    order_date: str = "AUDAT",
    amount: str = "NETWR",
    columns: Sequence[str] = HEADER_COLUMNS,
    tie_break: Sequence[str] | None = None,
    salts: int | None = None,
    opened: DataFrame | None = None,
) -> DataFrame:
    """K2: the ``n`` largest open orders with their age in days.

    Amounts are ranked across currencies as stored (no conversion); a NULL
    amount ranks first, as the largest. Ties are broken by ``tie_break``
    (default: the order key, then every other column, a total order) so the
    cut at ``n`` repeats. Result: ``columns``
    plus ``ORDER_AGE_DAYS`` (days from order date to ``as_of``).

    The top-n runs as a per-partition top-n plus one merge of at most
    ``n x partitions`` rows (``TakeOrderedAndProject``), never a full sort.
    ``salts`` spreads hot keys of the version pick (see
    ``versions.latest_version``). ``opened`` is the result of ``open_headers``
    where the caller has it; ``header`` is then not read.
    """
    orders = opened if opened is not None else open_headers(
        header, since, open_statuses, closed_status, key, version, salts=salts
    )
    if created_since is not None:
        orders = orders.filter(F.col(order_date) >= date_value(created_since))
    ties = (
        list(tie_break)
        if tie_break is not None
        else [key] + [c for c in columns if c not in (key, amount)]
    )
    return (
        orders.select(
            *columns,
            day_diff(F.col(order_date), date_value(as_of)).alias("ORDER_AGE_DAYS"),
        )
        .orderBy(*descending(amount), *ascending(*ties))
        .limit(n)
    )


def delayed_lines(
    header: DataFrame,
    lines: DataFrame,
    as_of=None,
    since=None,
    n: int = D.DELAYED_LINE_ROWS,
    open_statuses: Sequence[str] = D.OPEN_DELIVERY_STATUSES,
    closed_status: str = D.CLOSED_OVERALL_STATUS,
    tie_break: Sequence[str] | None = None,
    salts: int | None = None,
    opened: DataFrame | None = None,
    filter_bits: int | None = None,
    colocated: bool = False,
) -> DataFrame:
    """K3: the ``n`` most overdue schedule lines of open orders.

    A line is overdue when its requested date is before ``as_of``, it still
    has quantity to deliver (ordered > delivered) and ordered > 0, all judged
    on the newest version of the line; its order's newest header version must
    be open. Result columns: ``DELAY_COLUMNS``, most days late first; ties
    are broken by ``tie_break`` (default: order, line, then every other
    column, a total order, so the cut at ``n`` repeats even when a header's
    tied versions fan a line out).

    ``salts`` spreads hot keys of both version picks and of the line-order
    join (see ``operators.joins``). ``opened`` is the result of
    ``open_headers`` where the caller has it; ``header`` is then not read.

    With ``filter_bits`` lines are filtered by the open orders' keys
    (``joins.key_filter``, a map of that many bits) where they are scanned,
    before their version pick: all versions of a line share its order, so the
    rows are the same, and lines of closed orders are in no shuffle. Without
    ``opened`` this reads the header a second time.

    ``colocated``: both tables are stored in buckets of the order key (see
    ``versions.latest_version``); picks and join then need no exchange.
    """
    today = date_value(as_of)
    ties = (
        list(tie_break)
        if tie_break is not None
        else ["VBELN", "POSNR"] + [c for c in DELAY_COLUMNS if c not in ("VBELN", "POSNR", "DELAY_DAYS")]
    )
    if opened is None:
        opened = open_headers(header, since, open_statuses, closed_status, salts=salts, colocated=colocated)
    orders = opened.select("VBELN", "AUDAT", "AUART", "KUNNR", "NETWR", "WAERK")
    if filter_bits is not None:
        lines = key_filter(lines, opened.select("VBELN"), ["VBELN"], filter_bits)
    overdue = (
        latest_version(lines, ["VBELN", "POSNR"], "FILE_DATE", since, salts=salts, colocated=colocated)
        .filter(
            (F.col("EDATU") < today)
            & (F.col("WMENG") > F.col("LMENG"))
            & (F.col("WMENG") > 0)
        )
        .select(
            "VBELN", "POSNR", "EDATU", "WMENG",
            (F.col("WMENG") - F.col("LMENG")).alias("REMAIN_QTY"),
            day_diff(F.col("EDATU"), today).alias("DELAY_DAYS"),
        )
    )
    return (
        salted_join(overdue, orders, ["VBELN"], "inner", salts)
        .select(*DELAY_COLUMNS)
        .orderBy(*descending("DELAY_DAYS"), *ascending(*ties))
        .limit(n)
    )


def subtotals(report: DataFrame, key: str = "WAERK", amount: str = "NETWR") -> DataFrame:
    """K4: amount summed per currency over the rows of a (top-n) report.

    NULL currencies are left out and currencies come in order; NULL amounts
    count nothing, so a currency without any amount has a total of 0. Result:
    ``key, NET_TOTAL``.
    """
    return (
        report.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(38,2)").alias("NET_TOTAL"))
        .orderBy(*ascending(key))
    )


def row_count(report: DataFrame) -> DataFrame:
    """Number of rows of a report, as a one-row frame ``ROWS``."""
    return report.agg(F.count(F.lit(1)).alias("ROWS"))
