"""Catalog lookups (K18): data-dictionary rows of one table and distinct values
of a column (the preview is ``sources.tables.preview``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions.ordering import ascending


def dictionary(
    defs: DataFrame,
    table,
    table_col: str = "TABLE_NAME",
    order_col: str = "COLUMN_NAME",
) -> DataFrame:
    """The definition rows of one table, ordered by column name."""
    return defs.filter(F.col(table_col) == F.lit(table)).orderBy(*ascending(order_col))


def distinct_values(df: DataFrame, column: str, n: int | None = D.DISTINCT_VALUE_ROWS) -> DataFrame:
    """Distinct values of one column, at most ``n`` (any ``n`` of them
    when there are more; no order is implied)."""
    out = df.select(column).distinct()
    return out if n is None else out.limit(n)


def column_counts(df: DataFrame) -> DataFrame:
    """S4 with figures: ``POS, COLUMN_NAME, FILLED``, a row per column in
    order with the number of its non-NULL values. One aggregation over the
    table; only counts leave a task."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)])
    cells = [F.struct(F.lit(i + 1).alias("POS"), F.lit(c).alias("COLUMN_NAME"), F.col(f"_{i}").alias("FILLED")) for i, c in enumerate(df.columns)]
    return counts.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
