"""K2 open orders, K3 delayed lines, K4 subtotals, K5 digest."""

from __future__ import annotations

from salesloom.operators import orders
from salesloom.plans.digest import digest_lines
from tests.conftest import HEADER_SCHEMA, LINE_SCHEMA, d, money, qty


def _h(key, load, status="A", overall="B", amount=100, cur="USD", audat="2026-01-05"):
    return (key, d(load), d(audat), "ZOR", "C" + key, status, overall,
            None if amount is None else money(amount), cur)


def _l(key, pos, load, edatu, ordered, delivered):
    return (key, pos, d(load), d(edatu), qty(ordered), qty(delivered))


def test_business_filter_runs_after_version_pick(spark):
    header = spark.createDataFrame([
        _h("1", "2026-01-02", status="A"),
        _h("1", "2026-01-09", status="C"),     # newest version is closed
        _h("2", "2026-01-02", status="B"),
        _h("3", "2026-01-02", overall="C"),    # overall closed
        _h("4", "2026-01-02", overall=None),   # NULL status is not open
        _h("5", "2026-01-02", audat="2025-12-20"),  # created before the floor
    ], HEADER_SCHEMA)
    out = orders.open_orders(header, as_of="2026-02-01", since="2026-01-01",
                             created_since="2026-01-01").collect()
    assert [r.VBELN for r in out] == ["2"]
    assert out[0].ORDER_AGE_DAYS == 27


def test_top_n_order_nulls_first_and_tie_break(spark):
    header = spark.createDataFrame([
        _h("1", "2026-01-02", amount=50), _h("2", "2026-01-02", amount=None),
        _h("3", "2026-01-02", amount=70), _h("0", "2026-01-02", amount=70),
        _h("4", "2026-01-02", amount=10),
    ], HEADER_SCHEMA)
    out = orders.open_orders(header, as_of="2026-02-01", n=4).collect()
    assert [r.VBELN for r in out] == ["2", "0", "3", "1"]


def test_top_n_plan(spark):
    header = spark.createDataFrame([_h("1", "2026-01-02")], HEADER_SCHEMA)
    plan = orders.open_orders(header)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_delayed_lines_edges(spark):
    header = spark.createDataFrame([
        _h("1", "2026-01-02"), _h("2", "2026-01-02"),
        _h("3", "2026-01-02"), _h("3", "2026-01-05", status="C"),  # newest header closed
    ], HEADER_SCHEMA)
    lines = spark.createDataFrame([
        _l("1", "10", "2026-01-02", "2026-01-10", 5, 2),   # late 22 days, 3 open
        _l("1", "20", "2026-01-02", "2026-01-10", 5, 5),   # delivered = ordered
        _l("1", "30", "2026-01-02", "2026-02-01", 5, 0),   # requested today: not late
        _l("1", "40", "2026-01-02", "2026-01-10", 0, -1),  # ordered 0
        _l("2", "10", "2026-01-02", "2026-01-20", 9, 0),
        _l("2", "10", "2026-01-05", "2026-01-20", 9, 9),   # newest version delivered
        _l("3", "10", "2026-01-02", "2026-01-05", 9, 0),   # order closed
    ], LINE_SCHEMA)
    out = orders.delayed_lines(header, lines, as_of="2026-02-01", since="2026-01-01").collect()
    assert [(r.VBELN, r.POSNR, r.DELAY_DAYS, r.REMAIN_QTY) for r in out] == [("1", "10", 22, qty(3))]
    assert list(out[0].asDict()) == list(orders.DELAY_COLUMNS)


def test_delayed_lines_empty(spark):
    header = spark.createDataFrame([_h("1", "2026-01-02")], HEADER_SCHEMA)
    lines = spark.createDataFrame([_l("1", "10", "2026-01-02", "2026-03-10", 5, 2)], LINE_SCHEMA)
    assert orders.delayed_lines(header, lines, as_of="2026-02-01").count() == 0


def test_subtotals_drop_null_currency_and_sort(spark):
    report = spark.createDataFrame(
        [("USD", money(1.5)), ("EUR", money(2)), (None, money(9)), ("USD", money(3))],
        "WAERK string, NETWR decimal(18,2)",
    )
    out = orders.subtotals(report).collect()
    assert [(r.WAERK, r.NET_TOTAL) for r in out] == [("EUR", money(2)), ("USD", money(4.5))]
    assert orders.row_count(report).first().ROWS == 4


def test_subtotal_of_a_currency_without_amounts_is_zero(spark):
    report = spark.createDataFrame(
        [("EUR", None), ("EUR", None), ("USD", money(3)), ("USD", None)], "WAERK string, NETWR decimal(18,2)"
    )
    out = orders.subtotals(report).collect()
    assert [(r.WAERK, r.NET_TOTAL) for r in out] == [("EUR", money(0)), ("USD", money(3))]


def test_digest_keeps_the_width_of_null_cells(spark):
    header = spark.createDataFrame([
        _h("1", "2026-01-02", amount=None, cur="EUR"),
        _h("2", "2026-01-02", amount=5, cur=None),
        ("3", d("2026-01-02"), d("2026-01-05"), None, "C3", "A", "B", money(4), "USD"),
        ("4", d("2026-01-02"), None, "ZOR", "C4", "A", "B", money(3), "USD"),
    ], HEADER_SCHEMA)
    late = orders.delayed_lines(header, spark.createDataFrame([], LINE_SCHEMA), as_of="2026-02-01")
    text = [r.LINE for r in digest_lines(orders.open_orders(header, as_of="2026-02-01"), late, as_of="2026-02-01").collect()]
    rows = {t[0]: t for t in text if t[:2] in ("1 ", "2 ", "3 ", "4 ")}
    #          Order        Date         Type   Status         Amount Cur     Age
    assert rows["1"] == "1            2026-01-05   ZOR    Not delivered              EUR    27d"
    assert rows["2"] == "2            2026-01-05   ZOR    Not delivered            5        27d"
    assert rows["3"] == "3            2026-01-05          Not delivered            4 USD    27d"
    assert rows["4"] == "4                         ZOR    Not delivered            3 USD       "
    assert len({len(t) for t in rows.values()}) == 1
    assert "  Total(EUR): 0" in text


def test_digest_cuts_a_report_longer_than_n(spark):
    header = spark.createDataFrame([_h(str(k), "2026-01-02", amount=k) for k in range(50)], HEADER_SCHEMA)
    lines = spark.createDataFrame([_l(str(k), "10", "2026-01-02", "2026-01-10", 5, 2) for k in range(50)], LINE_SCHEMA)
    top = orders.open_orders(header, as_of="2026-02-01", n=50)
    late = orders.delayed_lines(header, lines, as_of="2026-02-01", n=50)
    text = [(r.SECTION, r.LINE) for r in digest_lines(top, late, as_of="2026-02-01", n=3, delayed_n=2).collect()]
    assert (0, "Total 3 (top 3 by amount)") in text and (1, "Total 2 (by days late)") in text
    assert [t.split()[0] for s, t in text if s == 0 and "delivered" in t] == ["49", "48", "47"]
    assert (0, "  Total(USD): 144") in text


def test_digest_lines(spark):
    header = spark.createDataFrame([
        _h("1", "2026-01-02", amount=1234.5, status="A"),
        _h("22", "2026-01-02", amount=2.5, status="B", cur="EUR"),
    ], HEADER_SCHEMA)
    lines = spark.createDataFrame([_l("1", "10", "2026-01-02", "2026-01-10", 5, 2)], LINE_SCHEMA)
    top = orders.open_orders(header, as_of="2026-02-01")
    late = orders.delayed_lines(header, lines, as_of="2026-02-01")
    text = [(r.SECTION, r.POS, r.LINE) for r in digest_lines(top, late, as_of="2026-02-01").collect()]
    sec0 = [t for s, _, t in text if s == 0]
    assert sec0[0] == "*[Open sales orders] as of 2026-02-01*"
    assert sec0[1] == "Total 2 (top 20 by amount)"
    assert sec0[2:4] == ["  Total(EUR): 2", "  Total(USD): 1,234"]  # half-even: 2.5 -> 2, 1234.5 -> 1234
    assert sec0[-1] == "```"
    row = [t for t in sec0 if t.startswith("1 ")][0]
    assert row.startswith("1            2026-01-05   ZOR    Not delivered")
    sec1 = [t for s, _, t in text if s == 1]
    assert any(t.startswith("1            00010  2026-01-05   2026-01-10          3  22d") for t in sec1)
    assert [p for s, p, _ in text if s == 1] == list(range(1, len(sec1) + 1))

    empty = orders.delayed_lines(header, lines, as_of="2026-01-01")
    sec1 = [r.LINE for r in digest_lines(top, empty, as_of="2026-01-01").collect() if r.SECTION == 1]
    assert sec1 == ["*[Overdue schedule lines] as of 2026-01-01*", "No overdue lines"]


def test_daily_digest_one_call(spark):
    from salesloom.plans.digest import daily_digest

    header = spark.createDataFrame([_h("1", "2026-01-02", amount=10), _h("2", "2026-01-02", amount=20)], HEADER_SCHEMA)
    lines = spark.createDataFrame([_l("2", "10", "2026-01-02", "2026-01-10", 5, 2)], LINE_SCHEMA)
    out = [(r.SECTION, r.LINE) for r in daily_digest(header, lines, as_of="2026-02-01", since="2026-01-01").collect()]
    assert out[1] == (0, "Total 2 (top 20 by amount)")
    assert (1, "Total 1 (by days late)") in out
    rows0 = [t for s, t in out if s == 0 and t[:1].isdigit()]
    assert [t.split()[0] for t in rows0] == ["2", "1"]  # larger amount first


def test_salts_give_the_same_reports(spark):
    header = spark.createDataFrame(
        [_h(str(k % 7), f"2026-01-0{1 + k % 5}", amount=k) for k in range(60)], HEADER_SCHEMA
    )
    lines = spark.createDataFrame(
        [_l(str(k % 7), str(k % 3), f"2026-01-0{1 + k % 4}", "2026-01-10", 5, k % 4) for k in range(90)], LINE_SCHEMA
    )
    a = orders.open_orders(header, as_of="2026-02-01", n=5).collect()
    b = orders.open_orders(header, as_of="2026-02-01", n=5, salts=4).collect()
    assert a == b
    # Rows tied on every sort key may come in either order: compare as multisets.
    c = orders.delayed_lines(header, lines, as_of="2026-02-01", n=500).collect()
    d = orders.delayed_lines(header, lines, as_of="2026-02-01", n=500, salts=4).collect()
    assert sorted(map(tuple, c)) == sorted(map(tuple, d)) and len(c) > 0
