"""S6-S8 extract CSV and K14-K17 dashboard slices over a generated extract,
with goldens worked out from its rule."""

from __future__ import annotations

import glob
from decimal import Decimal

import pytest

from salesloom.operators import dashboard as dash
from salesloom.sources.extract import read_extract, write_extract
from tests.conftest import money, qty

# Invented categories; HAMMER has rows in one month only.
CATS = ["ALPHA", "BETA", "GAMMA", "HAMMER"]
MONTHS = [f"2025-{m:02d}" for m in range(1, 13)] + [f"2026-{m:02d}" for m in range(1, 4)]


def _cells():
    """(month, category, qty, amount): month k of category i has 10 k + i pieces
    for 100.25 k + i each month; the last month has one row."""
    for k, month in enumerate(MONTHS[:-1], 1):
        for i, c in enumerate(CATS[:3], 1):
            yield month, c, Decimal(10 * k + i), Decimal("100.25") * k + i
    yield "2025-07", "HAMMER", Decimal(789), Decimal("214.50")
    yield MONTHS[-1], "ALPHA", Decimal(37), Decimal("1712.47")


@pytest.fixture(scope="module")
def extract(spark, tmp_path_factory):
    """The extract as a spreadsheet writes it: byte order mark, CRLF, header."""
    path = tmp_path_factory.mktemp("extract") / "sales.csv"
    lines = ["YEARMONTH,CATEGORY,QTY,NET_USD"] + [f"{m},{c},{q:.3f},{a:.2f}" for m, c, q, a in _cells()]
    path.write_bytes(b"\xef\xbb\xbf" + "".join(x + "\r\n" for x in lines).encode())
    return read_extract(spark, str(path))


@pytest.fixture()
def small(spark):
    rows = [("2025-01", "A", qty(1), money(10.5)), ("2025-01", "B", qty(2), money(999.5)),
            ("2025-02", "B", qty(3), money(2.25)), ("2025-03", "C", qty(4), money(1000000))]
    return spark.createDataFrame(rows, "YEARMONTH string, CATEGORY string, QTY decimal(18,3), NET_USD decimal(18,2)")


def test_read_extract(extract):
    assert extract.count() == 14 * 3 + 2
    assert extract.select("YEARMONTH").distinct().count() == 15
    assert extract.select("CATEGORY").distinct().count() == 4
    first = extract.orderBy("YEARMONTH", "CATEGORY").first()
    assert (first.YEARMONTH, first.CATEGORY, first.QTY, first.NET_USD) == ("2025-01", "ALPHA", qty(11), money("101.25"))
    assert extract.filter("YEARMONTH IS NULL OR NET_USD IS NULL").count() == 0


def test_default_range(extract):
    r = dash.default_range(extract).first()
    assert (r.LO, r.HI) == ("2025-01", "2026-02")


def test_default_range_single_month(small):
    r = dash.default_range(small.filter("YEARMONTH = '2025-02'")).first()
    assert (r.LO, r.HI) == ("2025-02", None)


def test_kpi_goldens(extract):
    # 1..14 adds up to 105: 3 * 1050 + 14 * 6 + 789 pieces, 3 * 100.25 * 105 + 14 * 6 + 214.50.
    k = dash.slice_kpis(extract, "2025-01", "2026-02", CATS).first()
    assert (k.TOTAL_QTY, k.TOTAL_AMOUNT, k.N_MONTHS) == (qty(4023), money("31877.25"), 14)
    assert k.AVG_AMOUNT == Decimal("2276.946429")
    assert (k.QTY_TEXT, k.AMOUNT_TEXT, k.AVG_TEXT) == ("4,023", "$32K", "$2K")
    k = dash.slice_kpis(extract, "2025-01", "2026-03", CATS).first()
    assert (k.TOTAL_QTY, k.TOTAL_AMOUNT, k.N_MONTHS) == (qty(4060), money("33589.72"), 15)
    k = dash.slice_kpis(extract, "2025-06", "2025-08", ["ALPHA", "GAMMA"]).first()
    assert (k.TOTAL_QTY, k.TOTAL_AMOUNT) == (qty(432), money("4222.50"))
    # One month with rows still averages over the five months of the range.
    k = dash.slice_kpis(extract, "2025-03", "2025-07", ["HAMMER"]).first()
    assert (k.TOTAL_AMOUNT, k.N_MONTHS, k.AVG_AMOUNT) == (money("214.50"), 5, Decimal("42.900000"))
    assert k.AVG_TEXT == "$43"
    k = dash.slice_kpis(extract, "2026-03", "2026-03", CATS).first()
    assert (k.TOTAL_QTY, k.TOTAL_AMOUNT) == (qty(37), money("1712.47"))


def test_category_totals_and_pivot_consistency(extract):
    want = {"ALPHA": (1064, "10540.25"), "BETA": (1078, "10554.25"), "GAMMA": (1092, "10568.25"), "HAMMER": (789, "214.50")}
    amt = dash.pivot_with_totals(extract, "2025-01", "2026-02", CATS, "amt").collect()
    q = dash.pivot_with_totals(extract, "2025-01", "2026-02", CATS, "qty").collect()
    assert [r.YEARMONTH for r in amt][-1] == "TOTAL" and len(amt) == 15
    tot_a, tot_q = amt[-1].asDict(), q[-1].asDict()
    for c, (wq, wa) in want.items():
        assert tot_q[c] == qty(wq) and tot_a[c] == Decimal(wa)
    body = amt[:-1]
    assert sum(r.TOTAL for r in body) == tot_a["TOTAL"] == sum(tot_a[c] for c in CATS) == money("31877.25")
    for r in body:
        assert r.TOTAL == sum(r[c] for c in CATS)


def test_dense_series(extract):
    rows = dash.dense_series(extract, "2025-03", "2025-07", ["HAMMER", "BETA"], "amt").orderBy("YEARMONTH", "POS").collect()
    assert len(rows) == 10
    assert [r.VALUE for r in rows if r.CATEGORY == "HAMMER"] == [0, 0, 0, 0, Decimal("215.000")]  # 214.50 rounds half up
    jul = [r for r in rows if r.YEARMONTH == "2025-07"]
    assert jul[0].MONTH_TOTAL == Decimal("215.000") + Decimal("704.000")  # 703.75
    assert [(r.VALUE_TEXT, r.TOTAL_TEXT) for r in jul] == [("$215", "$919"), ("$704", "$919")]
    qrows = dash.dense_series(extract, "2025-07", "2025-07", ["HAMMER", "ALPHA"], "qty").orderBy("POS").collect()
    assert [(r.VALUE, r.MONTH_TOTAL, r.VALUE_TEXT, r.TOTAL_TEXT) for r in qrows] == [
        (qty(789), qty(860), "789", "860"), (qty(71), qty(860), "71", "860")
    ]


def test_footer_rounds_a_quantity_total(spark):
    rows = [("2025-01", "A", qty("1000.25"), money(1)), ("2025-01", "B", qty("0.25"), money(1))]
    df = spark.createDataFrame(rows, "YEARMONTH string, CATEGORY string, QTY decimal(18,3), NET_USD decimal(18,2)")
    got = dash.dense_series(df, "2025-01", "2025-01", ["A", "B"], "qty").collect()
    assert {(r.VALUE_TEXT, r.TOTAL_TEXT) for r in got} == {("1,000.25", "1,001"), ("0.25", "1,001")}


def test_repeated_extract_keys_are_found(spark, small):
    twice = small.unionByName(small.limit(1))
    for job in (
        lambda df, **k: dash.slice_kpis(df, "2025-01", "2025-03", ["A"], **k),
        lambda df, **k: dash.dense_series(df, "2025-01", "2025-03", ["A"], **k),
        lambda df, **k: dash.pivot_with_totals(df, "2025-01", "2025-03", ["A"], **k),
    ):
        assert job(small, check_keys=True).count() > 0
        job(twice)
        with pytest.raises(ValueError, match="extract: 1 repeated"):
            job(twice, check_keys=True)
    labels = spark.createDataFrame([("A", "x"), ("A", "y")], "CATEGORY string, LABEL string")
    with pytest.raises(ValueError, match="labels: 1 repeated"):
        dash.label_categories(small, labels, check_keys=True)


def test_empty_slices(small):
    k = dash.slice_kpis(small, "2025-03", "2025-01", ["A"]).first()
    assert (k.TOTAL_QTY, k.TOTAL_AMOUNT, k.N_MONTHS, k.AVG_AMOUNT, k.AMOUNT_TEXT) == (0, 0, 0, 0, "$0")
    k = dash.slice_kpis(small, "2025-01", "2025-03", []).first()
    assert (k.TOTAL_AMOUNT, k.N_MONTHS) == (0, 3)
    assert dash.dense_series(small, "2025-03", "2025-01", ["A"]).count() == 0
    assert dash.dense_series(small, "2025-01", "2025-03", []).count() == 0
    p = dash.pivot_with_totals(small, "2025-03", "2025-01", ["A", "B"]).collect()
    assert [tuple(r) for r in p] == [("TOTAL", 0, 0, 0)]


def test_pivot_cells_and_display(small):
    p = dash.pivot_with_totals(small, "2025-01", "2025-03", ["B", "A"])
    assert p.columns == ["YEARMONTH", "B", "A", "TOTAL"]
    rows = [tuple(r) for r in p.collect()]
    assert rows == [
        ("2025-01", money(999.5), money(10.5), money(1010)),
        ("2025-02", money(2.25), money(0), money(2.25)),
        ("2025-03", money(0), money(0), money(0)),
        ("TOTAL", money(1001.75), money(10.5), money(1012.25)),
    ]
    shown = [tuple(r) for r in dash.pivot_display(p, ["B", "A"]).collect()]
    assert shown == [("2025-01", "$1,000", "$11", "$1,010"), ("2025-02", "$2", "-", "$2"),
                     ("2025-03", "-", "-", "$0"), ("TOTAL", "$1,002", "$11", "$1,012")]


def test_kpi_text_thresholds(small):
    k = dash.slice_kpis(small, "2025-01", "2025-03", ["C"]).first()
    assert k.AMOUNT_TEXT == "$1.00M"
    k = dash.slice_kpis(small, "2025-01", "2025-01", ["B"]).first()
    assert (k.AMOUNT_TEXT, k.QTY_TEXT) == ("$1,000", "2")


def test_write_extract_roundtrip(spark, small, tmp_path):
    out = str(tmp_path / "x")
    write_extract(small, out)
    raw = b"".join(open(f, "rb").read() for f in sorted(glob.glob(out + "/part-*")))
    assert b"\r\n" in raw and raw.startswith(b"YEARMONTH,CATEGORY,QTY,NET_USD\r\n")
    back = read_extract(spark, out)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, small.collect()))
