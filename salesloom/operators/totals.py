"""Totals by grouping sets (A14-A17, U1): one aggregation gives the cells, the
totals of each key and the grand total.

Spark runs grouping sets as one Expand (each row once per set) below a partial
aggregation, so only combined rows are shuffled, and marks each result row with
the keys that were rolled up (``grouping_id``): a NULL in the data is told from
a total.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import ascending
from .dashboard import CATEGORY, MONTH, _chosen, _in_range, _metric, _zero

LEVEL = "LEVEL"


def grouping_totals(
    df: DataFrame,
    keys: Sequence[str],
    sums: dict[str, str],
    how: str = "cube",
    total_label: str | None = None,
) -> DataFrame:
    """Sums of ``sums`` (result name -> column) by ``keys`` and by their
    subsets: all of them (``cube``) or the leading ones (``rollup``).

    Result: keys, sums, and ``LEVEL``, the number whose bits (first key
    highest) are set for keys that were summed over: 0 for a plain group, all
    bits for the grand total. A key that was summed over is NULL, or
    ``total_label`` (string keys). An empty table has no rows, no total
    either. The order is not fixed.
    """
    if how not in ("cube", "rollup"):
        raise ValueError("how must be 'cube' or 'rollup'")
    grouped = df.cube(*keys) if how == "cube" else df.rollup(*keys)
    out = grouped.agg(*[F.sum(c).alias(name) for name, c in sums.items()], F.grouping_id().alias(LEVEL))
    if total_label is None:
        return out
    named = []
    for i, k in enumerate(keys):
        rolled = F.col(LEVEL).bitwiseAND(1 << (len(keys) - 1 - i)) != 0
        named.append(F.when(rolled, F.lit(total_label)).otherwise(F.col(k)).alias(k))
    return out.select(*named, *sums, LEVEL)


def pivot_by_grouping_sets(
    extract: DataFrame,
    lo: str,
    hi: str,
    categories: Sequence[str],
    metric: str = "amt",
    total_label: str = "TOTAL",
) -> DataFrame:
    """K16 in one aggregation: the rows of ``dashboard.pivot_with_totals``
    (months, one column per category, a row total, a last row of column
    totals), from one rollup over the months.

    The total row is the group with the month rolled up, whatever a month is
    called. It is there with zeros for an empty range too: one marked row is
    added to the input, and the month group it makes is left out again.
    """
    value = _metric(metric)
    cats = list(categories)
    if len(set(cats)) != len(cats) or MONTH in cats or "TOTAL" in cats:
        raise ValueError("category names must be unique and not YEARMONTH/TOTAL")
    dec = "decimal(38,3)" if metric == "qty" else "decimal(38,2)"

    def total(of: Column) -> Column:
        return F.coalesce(F.sum(F.when(of, F.col(value))), _zero()).cast(dec)

    rows = _in_range(extract, lo, hi).select(MONTH, CATEGORY, value, F.lit(1).alias("_real"))
    mark = extract.sparkSession.range(1).select(
        F.lit(None).cast("string").alias(MONTH),
        F.lit(None).cast("string").alias(CATEGORY),
        F.lit(Decimal(0)).cast(rows.schema[value].dataType).alias(value),
        F.lit(0).alias("_real"),
    )
    out = rows.unionByName(mark).rollup(MONTH).agg(
        *[total(F.col(CATEGORY) == c).alias(c) for c in cats],
        total(_chosen(cats)).alias("TOTAL"),
        F.grouping_id().alias("_last"),
        F.sum("_real").alias("_real"),
    )
    named = F.when(F.col("_last") == 1, F.lit(total_label)).otherwise(F.col(MONTH)).alias(MONTH)
    return (
        out.filter((F.col("_last") == 1) | (F.col("_real") > 0))
        .select(named, *[F.col(f"`{c}`") for c in cats], "TOTAL", "_last")
        .orderBy(*ascending("_last", MONTH))
        .drop("_last")
    )
