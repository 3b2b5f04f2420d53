"""Versioned snapshot tables: newest version per key (K1), load-date
distribution (K11) and keys loaded more than once (K12).

A versioned table repeats its business key once per load, with the load date
(``FILE_DATE``) as version.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions.dates import date_value
from ..functions.ordering import ascending, descending
from .joins import salted_join


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def latest_version(
    df: DataFrame,
    keys: str | Sequence[str] = "VBELN",
    version: str = "FILE_DATE",
    since=None,
    salts: int | None = None,
    colocated: bool = False,
) -> DataFrame:
    """K1: the rows carrying the newest version of their key; ties are kept.

    ``since`` drops versions older than it before the newest one is picked, so
    a key whose newest version is older than ``since`` disappears. Rows with a
    NULL key or version never match (SQL equality), as in a MAX-join.

    Plan: the newest version per key is a grouped MAX, which Spark combines
    map-side, so a hot key costs one partial row per input partition. The rows
    are then kept by a left-semi join on (key, version): the join hashes on
    the version too, so a key with many loads spreads over many partitions,
    and a hot (key, version) group - e.g. a load copied many times - is split
    by AQE's skew-join handling. A window ``rank()`` would put every row of a
    hot key into one task, which AQE cannot split.

    ``salts`` (see ``operators.joins``) spreads a hot (key, version) group over
    several tasks without AQE: the newest versions, one row per key, are
    repeated and the rows dealt out.

    ``colocated`` is for tables stored with all rows of a key in one bucket
    (``sources.snapshots.write_bucketed``): the newest version is a windowed
    MAX over the bucket's rows, so the table is read once and nothing is
    shuffled. On other tables it would put a hot key into one task.

    Business filters (status, dates) must run on the result, not before: a
    closed newest version would otherwise let an older open one through.
    """
    key_cols = _keys(keys)
    if since is not None:
        df = df.filter(F.col(version) >= date_value(since))
    if colocated:
        keyed = df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key_cols]))
        newest = F.max(version).over(Window.partitionBy(*key_cols))
        return keyed.withColumn("_newest", newest).filter(F.col(version) == F.col("_newest")).drop("_newest")
    newest = df.groupBy(*key_cols).agg(F.max(version).alias(version))
    kept = salted_join(df, newest, [*key_cols, version], "left_semi", salts)
    return kept.select(*df.columns) if salts else kept


def version_distribution(
    lines: DataFrame,
    products: DataFrame | None = None,
    group: str | None = None,
    version: str = "FILE_DATE",
    amount: str = "NETWR",
    material: str = "MATNR",
    group_col: str = "MATKL",
    salts: int | None = None,
    check_keys: bool = False,
) -> DataFrame:
    """Rows and net amount per load date, optionally for one product group.

    Result: ``FILE_DATE, ROW_CNT, NET_USD`` ordered by load date.
    ``salts`` spreads hot materials of the product join
    (``operators.joins``); ``check_keys`` fails if a product is listed twice.
    """
    if products is not None and group is not None:
        if check_keys:
            require_unique(products, material, "products")
        chosen = products.filter(F.col(group_col) == group).select(material)
        lines = salted_join(lines, chosen, [material], "inner", salts)
    return (
        lines.groupBy(version)
        .agg(
            F.count(F.lit(1)).alias("ROW_CNT"),
            F.sum(amount).cast("decimal(38,2)").alias("NET_USD"),
        )
        .orderBy(*ascending(version))
    )


def duplicate_keys(
    df: DataFrame,
    keys: str | Sequence[str] = ("VBELN", "POSNR"),
    version: str = "FILE_DATE",
    products: DataFrame | None = None,
    group: str | None = None,
    n: int | None = D.DUPLICATE_KEY_ROWS,
    material: str = "MATNR",
    group_col: str = "MATKL",
    salts: int | None = None,
    check_keys: bool = False,
) -> DataFrame:
    """Keys present more than once, with first and last load date.

    Result: ``keys..., DUP_CNT, FIRST_DATE, LAST_DATE`` ordered by ``DUP_CNT``
    descending, then the keys; the first ``n`` (all when ``n`` is None). An
    empty result means the key is unique. ``salts`` spreads hot
    materials of the product join (``operators.joins``); ``check_keys`` fails
    if a product is listed twice.
    """
    key_cols = _keys(keys)
    if products is not None and group is not None:
        if check_keys:
            require_unique(products, material, "products")
        chosen = products.filter(F.col(group_col) == group).select(material)
        df = salted_join(df, chosen, [material], "inner", salts)
    dups = (
        df.groupBy(*key_cols)
        .agg(
            F.count(F.lit(1)).alias("DUP_CNT"),
            F.min(version).alias("FIRST_DATE"),
            F.max(version).alias("LAST_DATE"),
        )
        .filter(F.col("DUP_CNT") > 1)
        .orderBy(*descending("DUP_CNT"), *ascending(*key_cols))
    )
    return dups if n is None else dups.limit(n)


def duplicate_key_count(df: DataFrame, keys: str | Sequence[str]) -> int:
    """Eager check: how many keys occur more than once (0 means unique).

    Used to assert that a dimension key is unique before a join that would
    otherwise fan out sums. Only one number reaches the driver.
    """
    key_cols = _keys(keys)
    return (
        df.groupBy(*key_cols)
        .count()
        .filter(F.col("count") > 1)
        .count()
    )


def require_unique(df: DataFrame, keys: str | Sequence[str], what: str) -> DataFrame:
    """``df`` itself, or a ``ValueError`` with the number of repeated keys.

    Eager (one aggregation over the keys), so the jobs that call it do so only
    with ``check_keys=True``. Sums through a join on a repeated dimension key
    would otherwise fan out without a sign.
    """
    repeated = duplicate_key_count(df, keys)
    if repeated:
        raise ValueError(f"{what}: {repeated} repeated value(s) of {', '.join(_keys(keys))}")
    return df
