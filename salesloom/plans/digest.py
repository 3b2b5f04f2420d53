"""The daily digest (K5): the open-order and overdue-line reports as a table
of text lines.

Result: ``SECTION`` (0 open orders, 1 overdue lines), ``POS`` (line number
within the section, from 1) and ``LINE``. Sending the text anywhere is the
caller's business.

Each report is cut to its top ``n`` rows here (a proven bound), so each
section is built by one global aggregation over it: the rows are gathered in
report order, subtotals are computed over that bounded array with
higher-order functions, and the lines are exploded with their position. Each
report is therefore read exactly once - no re-run, no checkpoint, no window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions.dates import date_stamp, date_value
from ..functions.ordering import ascending, descending
from ..functions.text import pad_left, pad_right, status_label, thousands, zero_fill
from ..operators.orders import delayed_lines, open_headers, open_orders
from ..sources.stored import stored

# Display labels (English; the texts are presentation, not data). Fixed values:
# the column widths of both tables.
OPEN_TITLE = "[Open sales orders] as of "
DELAY_TITLE = "[Overdue schedule lines] as of "
NO_DELAY = "No overdue lines"
FENCE = "```"
RULE = "-" * 65
OPEN_HEAD = " ".join(
    [f"{'Order':<12}", f"{'Date':<12}", f"{'Type':<6}", f"{'Status':<8}",
     f"{'Amount':>12}", f"{'Cur':<5}", f"{'Age':>5}"]
)
# Row order inside each section, after the amount / days late: a total order.
OPEN_TIES = ("VBELN", "AUART", "AUDAT", "KUNNR", "LFSTK", "GBSTK", "WAERK", "ORDER_AGE_DAYS")
DELAY_TIES = ("VBELN", "POSNR", "AUDAT", "EDATU", "WMENG", "REMAIN_QTY", "KUNNR", "NETWR", "WAERK", "AUART")
DELAY_HEAD = " ".join(
    [f"{'Order':<12}", f"{'Item':<6}", f"{'Date':<12}", f"{'Requested':<12}",
     f"{'Open qty':>8}", f"{'Late':>5}"]
)


def _cell(c: Column | str) -> Column:
    """A cell's text; a NULL is an empty cell, which keeps its width when padded."""
    value = F.col(c) if isinstance(c, str) else c
    return F.coalesce(value.cast("string"), F.lit(""))


def _days(c: str) -> Column:
    """``12d``; empty for NULL."""
    return F.coalesce(F.concat(F.col(c).cast("string"), F.lit("d")), F.lit(""))


def _texts(*lines: str) -> Column:
    return F.array(*[F.lit(s) for s in lines])


def _concat_arrays(*arrays: Column) -> Column:
    return reduce(lambda a, b: F.concat(a, b), arrays)


def _ascending_keys(*cols: str) -> list[Column]:
    """Struct fields that sort ascending with NULL last, column by column."""
    fields = []
    for i, c in enumerate(cols):
        fields += [F.col(c).isNull().alias(f"N{i}"), F.col(c).alias(f"V{i}")]
    return fields


def _ordered_lines(rows: Column) -> Column:
    """Line texts of the gathered rows, in report order (the sort keys lead
    the struct, so ascending struct order is report order)."""
    return F.transform(F.sort_array(rows), lambda r: r["LINE"])


def _section(df: DataFrame, section: int) -> DataFrame:
    return df.select(
        F.lit(section).alias("SECTION"),
        F.posexplode("LINES").alias("POS", "LINE"),
    ).select("SECTION", (F.col("POS") + 1).alias("POS"), "LINE")


def open_section(open_report: DataFrame, day: Column, n: int, not_delivered: str) -> DataFrame:
    """Section 0, of the first ``n`` orders: title, count, per-currency totals, the table of orders."""
    open_report = open_report.orderBy(*descending("NETWR"), *ascending(*OPEN_TIES)).limit(n)
    line = F.concat_ws(
        " ",
        pad_right(_cell("VBELN"), 12), pad_right(_cell("AUDAT"), 12), pad_right(_cell("AUART"), 6),
        pad_right(status_label("LFSTK", not_delivered, "Not delivered", "Partly delivered"), 8),
        pad_left(_cell(thousands("NETWR")), 12), pad_right(_cell("WAERK"), 5),
        pad_left(_days("ORDER_AGE_DAYS"), 4),
    )
    row = F.struct(
        F.col("NETWR").isNotNull().cast("int").alias("K0"),  # NULL amount first
        (-F.col("NETWR")).alias("K1"),                       # then amount descending
        *_ascending_keys(*OPEN_TIES),                        # then the rest, NULL last
        F.col("WAERK").alias("CUR"),
        F.col("NETWR").alias("AMT"),
        line.alias("LINE"),
    )
    gathered = open_report.agg(F.count(F.lit(1)).alias("ROWS"), F.collect_list(row).alias("ROWS_"))
    currencies = F.array_sort(
        F.array_distinct(F.filter(F.transform("ROWS_", lambda r: r["CUR"]), lambda c: c.isNotNull()))
    )
    zero = F.lit(0).cast("decimal(38,2)")
    subtotal_lines = F.transform(
        currencies,
        lambda c: F.concat(
            F.lit("  Total("), c.cast("string"), F.lit("): "),
            F.format_number(
                F.aggregate(
                    F.filter("ROWS_", lambda r: r["CUR"] == c),
                    zero,
                    lambda acc, r: acc + F.coalesce(r["AMT"], zero),
                ),
                0,
            ),
        ),
    )
    lines = _concat_arrays(
        F.array(
            F.concat(F.lit("*" + OPEN_TITLE), day, F.lit("*")),
            F.concat(F.lit("Total "), F.col("ROWS").cast("string"), F.lit(f" (top {n} by amount)")),
        ),
        subtotal_lines,
        _texts("", FENCE, OPEN_HEAD, RULE),
        _ordered_lines(F.col("ROWS_")),
        _texts(FENCE),
    )
    return _section(gathered.select(lines.alias("LINES")), 0)


def delay_section(delayed_report: DataFrame, day: Column, n: int) -> DataFrame:
    """Section 1, of the first ``n`` lines: title and either the table of overdue lines or one line
    saying there are none."""
    delayed_report = delayed_report.orderBy(*descending("DELAY_DAYS"), *ascending(*DELAY_TIES)).limit(n)
    line = F.concat_ws(
        " ",
        pad_right(_cell("VBELN"), 12), pad_right(_cell(zero_fill("POSNR", 5)), 6),
        pad_right(_cell("AUDAT"), 12), pad_right(_cell("EDATU"), 12),
        pad_left(_cell(thousands("REMAIN_QTY")), 8),
        pad_left(_days("DELAY_DAYS"), 4),
    )
    row = F.struct(
        F.col("DELAY_DAYS").isNotNull().cast("int").alias("K0"),
        (-F.col("DELAY_DAYS")).alias("K1"),
        *_ascending_keys(*DELAY_TIES),
        line.alias("LINE"),
    )
    gathered = delayed_report.agg(F.count(F.lit(1)).alias("ROWS"), F.collect_list(row).alias("ROWS_"))
    title = F.concat(F.lit("*" + DELAY_TITLE), day, F.lit("*"))
    table = _concat_arrays(
        F.array(title, F.concat(F.lit("Total "), F.col("ROWS").cast("string"), F.lit(" (by days late)"))),
        _texts("", FENCE, DELAY_HEAD, RULE),
        _ordered_lines(F.col("ROWS_")),
        _texts(FENCE),
    )
    lines = F.when(F.col("ROWS") == 0, F.array(title, F.lit(NO_DELAY))).otherwise(table)
    return _section(gathered.select(lines.alias("LINES")), 1)


def digest_lines(
    open_report: DataFrame,
    delayed_report: DataFrame,
    as_of=None,
    n: int = D.OPEN_ORDER_ROWS,
    not_delivered: str = D.NOT_DELIVERED_STATUS,
    delayed_n: int = D.DELAYED_LINE_ROWS,
) -> DataFrame:
    """K5: both report sections as ordered text lines.

    A report longer than ``n`` (``delayed_n``) rows is cut to it in report
    order; a NULL column is an empty cell of the same width.

    ``open_report`` is ``open_orders`` output, ``delayed_report`` is
    ``delayed_lines`` output; ``not_delivered`` is the delivery-status code
    shown as "Not delivered" (every other code is "Partly delivered").
    Subtotals follow a grouped sum over the report rows: currencies in
    order, a NULL currency left out.
    """
    day = date_stamp(date_value(as_of))
    return (
        open_section(open_report, day, n, not_delivered)
        .unionByName(delay_section(delayed_report, day, delayed_n))
        .orderBy(*ascending("SECTION", "POS"))
    )


def daily_digest(
    header: DataFrame,
    lines: DataFrame,
    as_of=None,
    since=None,
    created_since=None,
    n: int = D.OPEN_ORDER_ROWS,
    delayed_n: int = D.DELAYED_LINE_ROWS,
    open_statuses=D.OPEN_DELIVERY_STATUSES,
    closed_status: str = D.CLOSED_OVERALL_STATUS,
    not_delivered: str = D.NOT_DELIVERED_STATUS,
    shared: bool = True,
    filter_bits: int = 22,
) -> DataFrame:
    """The whole daily run: the ``n`` largest open orders, the
    ``delayed_n`` most overdue lines, and the digest lines of both.

    ``header`` and ``lines`` are the order-header and schedule-line snapshot
    tables in the model's columns; ``since`` is the load-date floor of both,
    ``created_since`` the order-date floor of the open-order report (the
    overdue report has none).

    With ``shared`` the open orders are worked out once and stored for the run
    (``sources.stored``; this part is eager): both sections read them, and
    the lines are filtered by their keys before their version pick
    (``filter_bits``, see ``orders.delayed_lines``). The header table is read
    for one version pick, not two.
    """
    opened = stored(open_headers(header, since, open_statuses, closed_status), "open-orders") if shared else None
    top = open_orders(
        header, as_of=as_of, since=since, created_since=created_since, n=n,
        open_statuses=open_statuses, closed_status=closed_status, opened=opened,
    )
    late = delayed_lines(
        header, lines, as_of=as_of, since=since, n=delayed_n,
        open_statuses=open_statuses, closed_status=closed_status, opened=opened,
        filter_bits=filter_bits if shared else None,
    )
    return digest_lines(top, late, as_of=as_of, n=n, not_delivered=not_delivered, delayed_n=delayed_n)
