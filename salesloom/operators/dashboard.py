"""Slices of the month x category extract: KPIs (K14), a dense chart series
(K15), a pivot with row and column totals (K16) and the default month range
(K17).

The extract has one row per (YEARMONTH, CATEGORY) with QTY and NET_USD; the
key must be unique (``check_keys=True`` fails if it is not; sums would count a
repeated row twice). A
month range is inclusive on the ``yyyy-MM`` text; ``lo > hi`` selects
nothing. Categories are an ordered list; an empty list selects nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import ascending
from ..functions.text import compact_money, dash_unless_positive, plain_number, round_half_up
from .versions import require_unique

METRICS = {"amt": "NET_USD", "qty": "QTY"}
MONTH, CATEGORY = "YEARMONTH", "CATEGORY"


def _zero() -> Column:
    return F.lit(Decimal(0))


def _metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {sorted(METRICS)}, not {metric!r}")
    return METRICS[metric]


def _in_range(extract: DataFrame, lo: str, hi: str) -> DataFrame:
    return extract.filter(F.col(MONTH).between(lo, hi))


def _chosen(categories: Sequence[str]) -> Column:
    return F.col(CATEGORY).isin(list(categories)) if categories else F.lit(False)


def slice_kpis(
    extract: DataFrame, lo: str, hi: str, categories: Sequence[str], check_keys: bool = False
) -> DataFrame:
    """One row of KPIs for a month range and a category set.

    ``TOTAL_QTY`` and ``TOTAL_AMOUNT`` cover the chosen categories (0 when
    nothing is chosen). ``N_MONTHS`` counts the range's months present in the
    whole extract, *before* the category filter, and ``AVG_AMOUNT`` divides by
    it (0 when there is no month) - a category with rows in one month of ten
    still averages over ten. Display text follows the dashboard: plain number
    for the quantity, compact money for amount and average.
    """
    if check_keys:
        require_unique(extract, [MONTH, CATEGORY], "extract")
    sel = _chosen(categories)
    kpis = _in_range(extract, lo, hi).agg(
        F.coalesce(F.sum(F.when(sel, F.col("QTY"))), _zero()).cast("decimal(38,3)").alias("TOTAL_QTY"),
        F.coalesce(F.sum(F.when(sel, F.col("NET_USD"))), _zero())
        .cast("decimal(38,2)")
        .alias("TOTAL_AMOUNT"),
        F.count_distinct(F.col(MONTH)).alias("N_MONTHS"),
    )
    avg = F.when(
        F.col("N_MONTHS") > 0, F.col("TOTAL_AMOUNT") / F.col("N_MONTHS")
    ).otherwise(_zero())
    return kpis.select(
        "TOTAL_QTY",
        "TOTAL_AMOUNT",
        "N_MONTHS",
        avg.cast("decimal(38,6)").alias("AVG_AMOUNT"),
    ).select(
        "*",
        plain_number("TOTAL_QTY").alias("QTY_TEXT"),
        compact_money("TOTAL_AMOUNT").alias("AMOUNT_TEXT"),
        compact_money("AVG_AMOUNT").alias("AVG_TEXT"),
    )


def _per_month(in_range: DataFrame, categories: Sequence[str], value: str) -> DataFrame:
    """One row per month of the range, one sum column per chosen category."""
    return in_range.groupBy(MONTH).agg(
        *[
            F.sum(F.when(F.col(CATEGORY) == c, F.col(value))).alias(f"_c{i}")
            for i, c in enumerate(categories)
        ]
    )


def dense_series(
    extract: DataFrame,
    lo: str,
    hi: str,
    categories: Sequence[str],
    metric: str = "amt",
    check_keys: bool = False,
) -> DataFrame:
    """Chart series - every month of the range x every chosen category.

    Missing cells are 0. Amounts are rounded half-up to whole units, as the
    chart plots them; quantities are plotted as they are. ``MONTH_TOTAL`` is
    the sum of the plotted values of the month (the stacked bar's total);
    ``VALUE_TEXT`` is the tooltip text of a cell (``$12,345`` / ``1,234.5``),
    ``TOTAL_TEXT`` its footer: the month's total rounded half-up.
    Result: ``YEARMONTH, CATEGORY, POS`` (category order), ``VALUE``,
    ``MONTH_TOTAL``, ``VALUE_TEXT``, ``TOTAL_TEXT``.

    Built as one grouped aggregation over months with a conditional sum per
    category, then unpivoted; no join and no cross product.
    """
    value, prefix = _metric(metric), "$" if metric == "amt" else ""
    if check_keys:
        require_unique(extract, [MONTH, CATEGORY], "extract")
    in_range = _in_range(extract, lo, hi)
    schema = (
        "YEARMONTH string, CATEGORY string, POS int, VALUE decimal(38,3), "
        "MONTH_TOTAL decimal(38,3), VALUE_TEXT string, TOTAL_TEXT string"
    )
    if not categories:
        return in_range.sparkSession.createDataFrame([], schema)
    wide = _per_month(in_range, categories, value)

    def plotted(i: int) -> Column:
        v = F.coalesce(F.col(f"_c{i}"), _zero())
        return (round_half_up(v) if metric == "amt" else v).cast("decimal(38,3)")

    cells = [
        F.struct(F.lit(c).alias(CATEGORY), F.lit(i).alias("POS"), plotted(i).alias("VALUE"))
        for i, c in enumerate(categories)
    ]
    total = reduce(lambda a, b: a + b, [plotted(i) for i in range(len(categories))])
    return wide.select(
        MONTH,
        F.explode(F.array(*cells)).alias("cell"),
        total.cast("decimal(38,3)").alias("MONTH_TOTAL"),
    ).select(
        MONTH, "cell.CATEGORY", "cell.POS", "cell.VALUE", "MONTH_TOTAL",
        F.concat(F.lit(prefix), plain_number("cell.VALUE")).alias("VALUE_TEXT"),
        F.concat(F.lit(prefix), F.format_number(round_half_up("MONTH_TOTAL"), 0)).alias("TOTAL_TEXT"),
    )


def pivot_with_totals(
    extract: DataFrame,
    lo: str,
    hi: str,
    categories: Sequence[str],
    metric: str = "amt",
    total_label: str = "TOTAL",
    check_keys: bool = False,
) -> DataFrame:
    """Months as rows, one column per chosen category (in order), a row
    total ``TOTAL`` and a last row ``total_label`` with the column totals.

    Every month of the range in the whole extract gets a row, with 0 where a
    category has nothing. Values are exact sums; rounding is display
    (``pivot_display``). The total row is an aggregate of the month rows; the
    two branches share one shuffle (Spark reuses the exchange).
    """
    value = _metric(metric)
    cats = list(categories)
    if len(set(cats)) != len(cats) or MONTH in cats or "TOTAL" in cats:
        raise ValueError("category names must be unique and not YEARMONTH/TOTAL")
    if check_keys:
        require_unique(extract, [MONTH, CATEGORY], "extract")
    dec = "decimal(38,3)" if metric == "qty" else "decimal(38,2)"
    sel = _chosen(cats)
    body = _in_range(extract, lo, hi).groupBy(MONTH).agg(
        *[
            F.coalesce(F.sum(F.when(F.col(CATEGORY) == c, F.col(value))), _zero()).cast(dec).alias(c)
            for c in cats
        ],
        F.coalesce(F.sum(F.when(sel, F.col(value))), _zero()).cast(dec).alias("TOTAL"),
    )
    totals = body.agg(
        *[F.coalesce(F.sum(F.col(f"`{c}`")), _zero()).cast(dec).alias(c) for c in cats],
        F.coalesce(F.sum("TOTAL"), _zero()).cast(dec).alias("TOTAL"),
    ).select(F.lit(total_label).alias(MONTH), *[F.col(f"`{c}`") for c in cats], "TOTAL")
    return (
        body.select(F.lit(0).alias("_last"), "*")
        .unionByName(totals.select(F.lit(1).alias("_last"), "*"))
        .orderBy(*ascending("_last", MONTH))
        .drop("_last")
    )


def pivot_display(
    pivot: DataFrame,
    categories: Sequence[str],
    metric: str = "amt",
    total_label: str = "TOTAL",
) -> DataFrame:
    """K16 display: cells rounded half-up with thousands separators (``$`` for
    amounts); a category cell that is not > 0 shows ``-``; totals always show
    a number."""
    prefix = "$" if _metric(metric) == "NET_USD" else ""

    def shown(c: Column) -> Column:
        return F.concat(F.lit(prefix), F.format_number(round_half_up(c), 0))

    cells = [
        F.when(
            F.col(MONTH) == F.lit(total_label), shown(F.col(f"`{c}`"))
        ).otherwise(dash_unless_positive(F.col(f"`{c}`"), shown(F.col(f"`{c}`")))).alias(c)
        for c in categories
    ]
    return pivot.select(MONTH, *cells, shown(F.col("TOTAL")).alias("TOTAL"))


def default_range(extract: DataFrame) -> DataFrame:
    """The dashboard's default range: the first month of the extract to
    the second-to-last one (the newest month is usually partial).

    One row ``LO, HI``; ``HI`` is NULL when the extract has a single month.
    The newest month is a scalar subquery; no window and no collect.
    """
    months = extract.select(MONTH)
    newest = months.select(F.max(MONTH)).scalar()
    return months.agg(
        F.min(MONTH).alias("LO"),
        F.max(F.when(F.col(MONTH) < newest, F.col(MONTH))).alias("HI"),
    )


def label_categories(
    df: DataFrame,
    labels: DataFrame,
    key: str = CATEGORY,
    label: str = "LABEL",
    check_keys: bool = False,
) -> DataFrame:
    """Add the display label of each category code.

    ``labels`` is a ``key -> label`` dimension (unique key); a code without a
    label shows as itself. A left join: AQE broadcasts the dimension when its
    run-time size is under the broadcast threshold.
    """
    if check_keys:
        require_unique(labels, key, "labels")
    return df.join(labels.select(key, F.col(label).alias("_label")), on=key, how="left").select(
        *df.columns, F.coalesce(F.col("_label"), F.col(key)).alias(label)
    )
