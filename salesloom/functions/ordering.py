"""Sort keys in the reference's NULL order: NULL is the largest value, so it
comes last in ascending order and first in descending order. (Spark's default
is the opposite.) It decides which rows survive a top-n cut."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascending(*cols: Column | str) -> list[Column]:
    """Ascending, NULL last."""
    return [_col(c).asc_nulls_last() for c in cols]


def descending(*cols: Column | str) -> list[Column]:
    """Descending, NULL first."""
    return [_col(c).desc_nulls_first() for c in cols]
