"""Number and text formatting (I5-I7, I9-I13) as Column expressions.

All of these run inside Spark (no Python UDF), so they stay in whole-stage
codegen next to the query that produces the numbers.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _half() -> Column:
    return F.lit(Decimal("0.5"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_right(c: Column | str, width: int, fill: str = " ") -> Column:
    """Left-aligned text in ``width`` characters; longer text is kept whole."""
    s = _col(c).cast("string")
    return F.rpad(s, F.greatest(F.lit(width), F.length(s)), fill)


def pad_left(c: Column | str, width: int, fill: str = " ") -> Column:
    """Right-aligned text in ``width`` characters; longer text is kept whole."""
    s = _col(c).cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), fill)


def zero_fill(c: Column | str, width: int = 5) -> Column:
    """Zero-filled key (line numbers); keys longer than ``width`` stay whole."""
    return pad_left(c, width, "0")


def thousands(c: Column | str, digits: int = 0) -> Column:
    """Thousands separators, ``digits`` decimals, half-even rounding."""
    return F.format_number(_col(c), digits)


def round_half_up(c: Column | str) -> Column:
    """Round half toward +infinity (``floor(x + 0.5)``), as a dashboard does.

    Exact on decimals (the 0.5 is a decimal literal)."""
    return F.floor(_col(c) + _half())


def plain_number(c: Column | str, max_digits: int = 3) -> Column:
    """Thousands separators and at most ``max_digits`` decimals, trailing zeros
    dropped (``1,421,150`` / ``1,234.5``)."""
    s = F.format_number(_col(c), max_digits)
    s = F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1")
    return F.regexp_replace(s, r"\.$", "")


def compact_money(c: Column | str, prefix: str = "$") -> Column:
    """``$10.13M`` from a million up, ``$596K`` from a thousand up, else ``$812``.

    Rounding is half-up on the exact decimal value (taken as decimal(24,6),
    so products below stay exact and are rounded once).
    """
    v = _col(c).cast("decimal(24,6)")
    millions = F.round(v * F.lit(0.000001).cast("decimal(7,6)"), 2).cast("decimal(38,2)").cast("string")
    thousands_ = F.format_number(round_half_up(v * F.lit(0.001).cast("decimal(4,3)")), 0)
    units = F.format_number(round_half_up(v), 0)
    return (
        F.when(v >= 1_000_000, F.concat(F.lit(prefix), millions, F.lit("M")))
        .when(v >= 1_000, F.concat(F.lit(prefix), thousands_, F.lit("K")))
        .otherwise(F.concat(F.lit(prefix), units))
    )


def axis_label(c: Column | str, metric: str = "amt") -> Column:
    """Chart axis text: amounts ``$1.2M`` / ``$350K``, quantities ``12K`` / ``850``;
    no thousands separators."""
    v = _col(c).cast("decimal(24,6)")
    k = F.round(v * F.lit(0.001).cast("decimal(4,3)"), 0).cast("decimal(38,0)").cast("string")
    if metric == "amt":
        m = F.round(v * F.lit(0.000001).cast("decimal(7,6)"), 1).cast("decimal(38,1)").cast("string")
        return F.when(v >= 1_000_000, F.concat(F.lit("$"), m, F.lit("M"))).otherwise(
            F.concat(F.lit("$"), k, F.lit("K"))
        )
    if metric == "qty":
        return F.when(v >= 1_000, F.concat(k, F.lit("K"))).otherwise(F.regexp_replace(plain_number(c), ",", ""))
    raise ValueError(f"metric must be 'amt' or 'qty', not {metric!r}")


def dash_unless_positive(value: Column | str, text: Column | str) -> Column:
    """The display text when the value is > 0, else ``-``."""
    return F.when(_col(value) > 0, _col(text)).otherwise(F.lit("-"))


def status_label(c: Column | str, open_code: str, open_label: str, other_label: str) -> Column:
    """One label for ``open_code``, another for every other value."""
    return F.when(_col(c) == open_code, F.lit(open_label)).otherwise(F.lit(other_label))
