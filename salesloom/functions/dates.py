"""Date helpers (I2-I4, I8) as Column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_value(value: str | dt.date | Column | None) -> Column:
    """A date Column from an ISO string, a ``date``, a Column or None (today).

    I2: "today" is a parameter (``as_of``) so that a run can be repeated; None
    means ``current_date()`` in the session time zone.
    """
    if value is None:
        return F.current_date()
    if isinstance(value, Column):
        return F.to_date(value)
    if isinstance(value, str):
        value = dt.date.fromisoformat(value)
    if isinstance(value, dt.datetime):
        value = value.date()
    return F.lit(value)


def day_diff(start: Column | str, end: Column | str) -> Column:
    """Whole calendar days from ``start`` to ``end`` (end - start).

    Both sides are taken as dates first, so 23:00 -> 01:00 the next day is one
    day, as a calendar-day difference should be.
    """
    return F.date_diff(F.to_date(end), F.to_date(start))


def month_key(d: Column | str) -> Column:
    """I4: ``yyyy-MM`` text of the month a date falls in (sorts as text)."""
    return F.date_format(F.to_date(d), "yyyy-MM")


def date_stamp(d: Column | str) -> Column:
    """I8: ``yyyy-MM-dd`` text of a date."""
    return F.date_format(F.to_date(d), "yyyy-MM-dd")
