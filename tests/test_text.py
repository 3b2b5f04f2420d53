"""Column helpers for dates and display text."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from salesloom.functions import dates, text


def _one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_day_diff_and_month_key(spark):
    r = _one(
        spark,
        dates.day_diff(F.lit("2026-01-31 23:00:00").cast("timestamp"), F.lit("2026-02-01 01:00:00").cast("timestamp")),
        dates.day_diff(F.lit("2026-03-01").cast("date"), dates.date_value("2026-02-01")),
        dates.month_key(F.lit("2026-02-28").cast("date")),
        dates.date_stamp(dates.date_value("2026-02-03")),
    )
    assert tuple(r) == (1, -28, "2026-02", "2026-02-03")


def test_padding_never_truncates(spark):
    r = _one(spark, text.pad_right(F.lit("abcdef"), 4), text.pad_right(F.lit("ab"), 4),
             text.pad_left(F.lit("ab"), 4), text.zero_fill(F.lit("10")), text.zero_fill(F.lit("1234567")))
    assert tuple(r) == ("abcdef", "ab  ", "  ab", "00010", "1234567")


def test_number_formats(spark):
    vals = [Decimal("0.5"), Decimal("1.5"), Decimal("2.5"), Decimal("1234567.5")]
    r = _one(spark, *[text.thousands(F.lit(v)) for v in vals])
    assert tuple(r) == ("0", "2", "2", "1,234,568")  # half-even
    r = _one(spark, *[text.round_half_up(F.lit(v)) for v in [Decimal("2.5"), Decimal("-2.5"), Decimal("2.49")]])
    assert tuple(r) == (3, -2, 2)
    r = _one(spark, text.plain_number(F.lit(Decimal("1421150.000"))), text.plain_number(F.lit(Decimal("1234.500"))))
    assert tuple(r) == ("1,421,150", "1,234.5")


def test_compact_money(spark):
    cases = {
        "10128644.01": "$10.13M", "595802.588824": "$596K", "999.5": "$1,000", "999.49": "$999",
        "1000": "$1K", "999999.6": "$1,000K", "1000000": "$1.00M", "1005000": "$1.01M", "0": "$0",
    }
    r = _one(spark, *[text.compact_money(F.lit(Decimal(k))) for k in cases])
    assert list(r) == list(cases.values())


def test_axis_labels_and_dash(spark):
    r = _one(spark, text.axis_label(F.lit(Decimal("1250000")), "amt"), text.axis_label(F.lit(Decimal("350400")), "amt"),
             text.axis_label(F.lit(Decimal("12500")), "qty"), text.axis_label(F.lit(850), "qty"),
             text.dash_unless_positive(F.lit(0), F.lit("x")), text.dash_unless_positive(F.lit(2), F.lit("x")),
             text.status_label(F.lit("A"), "A", "open", "partial"), text.status_label(F.lit(None), "A", "open", "partial"))
    assert tuple(r) == ("$1.3M", "$350K", "13K", "850", "-", "x", "open", "partial")
