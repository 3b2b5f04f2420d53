"""Table sources (S1-S5): named tables, SQL text over registered views, column
lists and unordered previews."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .. import defaults as D


def load_table(
    spark: SparkSession,
    name: str,
    base: str | None = None,
    suffix: str = ".parquet",
) -> DataFrame:
    """A named table.

    With ``base`` the table is the parquet dataset ``{base}/{name}{suffix}``
    (a file or a folder, e.g. one partitioned by load date); without it the
    name is looked up in the session catalog. Either way the scan is lazy, so
    column pruning and filter push-down reach the files.
    """
    if base is None:
        return spark.table(name)
    return spark.read.parquet(f"{base.rstrip('/')}/{name}{suffix}")


def run_sql(
    spark: SparkSession,
    text: str,
    views: Mapping[str, DataFrame] | None = None,
    args: Mapping[str, Any] | None = None,
) -> DataFrame:
    """SQL text to a lazy frame.

    ``views`` are registered as temporary views first; ``args`` are bound as
    named parameters (``:name`` markers) instead of being pasted into the text.
    """
    for view_name, frame in (views or {}).items():
        frame.createOrReplaceTempView(view_name)
    return spark.sql(text, args=dict(args) if args else None)


def use_schema(spark: SparkSession, schema: str) -> None:
    """S3: default schema (database) for unqualified table names."""
    spark.catalog.setCurrentDatabase(schema)


def column_names(df: DataFrame) -> list[str]:
    """The column list of a result, in order (no job runs)."""
    return list(df.columns)


def preview(df: DataFrame, n: int = D.PREVIEW_ROWS) -> DataFrame:
    """Any ``n`` rows, in no particular order."""
    return df.limit(n)


def write_versioned(
    df: DataFrame,
    path: str,
    version: str = "FILE_DATE",
    mode: str = "append",
) -> None:
    """Store a versioned snapshot table as parquet partitioned by load date.

    One folder per load date: a version floor (``since``) or the newest-load
    cut of ``monthly_sales(snapshot="global_latest")`` then reads only the
    matching folders (partition pruning; the newest-load subquery is applied
    at run time).

    Rows are clustered by load date with the ``rebalance`` hint, so each task
    writes few files; AQE splits a load date that is too large for one task
    (a full snapshot load can be a third of the table) and merges small ones.
    """
    (
        df.hint("rebalance", version)
        .write.mode(mode)
        .partitionBy(version)
        .parquet(path)
    )
