"""Jobs over the test tables with their SQL oracles.

Each job maps a reference query onto the stand-in tables (see
``sources.standins``) with fixed stand-in parameters. The oracles are written
over the raw columns of the test tables and share no constants with the jobs'
code but the parameters below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import axis_label
from ..operators import dashboard as dash
from ..operators import keywords as kw
from ..operators import orders as ord_ops
from ..operators import sales, totals, versions
from ..operators.catalog import dictionary, distinct_values
from ..sources import standins
from ..sources.tables import load_table, preview, run_sql
from . import digest as dg
from .registry import register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, listed anew for each job, so rows that are added are seen."""
    return load_table(spark, name, base=sf_dir)


# ---------------------------------------------------------------------------
# Stand-in parameters (chosen for the test tables; the reference's own values
# are SAP codes and 2026 dates).
# ---------------------------------------------------------------------------
HEADER_SINCE = "1997-01-01"
CREATED_SINCE = "1998-01-01"
REPORT_AS_OF = "2002-01-01"
LINES_SINCE = "1997-01-01"
DELAY_AS_OF = "2000-01-01"
OPEN_STATUSES = ("O", "P")
CLOSED_STATUS = "5-LOW"

# Oracle texts over the raw tables. The newest version is the first rank by
# day within the key (ties share it); nothing is joined to a MAX.
def _sql_orders(key: str, since: str | None = None) -> str:
    floor = f" WHERE CAST(o_orderdate AS DATE) >= DATE '{since}'" if since else ""
    return f"""
  SELECT *, CAST(o_orderdate AS DATE) AS order_day FROM orders{floor}
  QUALIFY rank() OVER (PARTITION BY {key} ORDER BY CAST(o_orderdate AS DATE) DESC) = 1"""


SQL_NEWEST_LINES = f"""
  SELECT *, CAST(l_shipdate AS DATE) AS ship_day FROM lineitem WHERE l_shipdate >= TIMESTAMP '{LINES_SINCE}'
  QUALIFY rank() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CAST(l_shipdate AS DATE) DESC) = 1"""

SQL_K1_HEADER = f"""
SELECT o_custkey AS VBELN, order_day AS FILE_DATE, order_day AS AUDAT, o_orderkey::VARCHAR AS AUART,
       o_custkey AS KUNNR, o_orderstatus AS LFSTK, o_orderpriority AS GBSTK,
       o_totalprice::DECIMAL(18,2) AS NETWR, o_orderpriority AS WAERK
FROM ({_sql_orders("o_custkey")}) newest"""


# ---------------------------------------------------------------------------
# K1 newest version per key
# ---------------------------------------------------------------------------
@register("k1_latest_header", oracle=SQL_K1_HEADER)
def k1_latest_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = standins.order_header(_t(spark, sf_dir, "orders"), key="o_custkey")
    return versions.latest_version(header, "VBELN", "FILE_DATE")


@register("k1_latest_header_hotkeys", oracle=SQL_K1_HEADER)
def k1_latest_header_hotkeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 with salting: each (customer, load) group is spread over 4 tasks."""
    header = standins.order_header(_t(spark, sf_dir, "orders"), key="o_custkey")
    return versions.latest_version(header, "VBELN", "FILE_DATE", salts=4)


@register(
    "k1_latest_lines",
    oracle=f"""
SELECT l_orderkey AS VBELN, l_linenumber AS POSNR, ship_day AS FILE_DATE, ship_day AS EDATU,
       l_quantity::DECIMAL(18,3) AS WMENG, (l_discount * 100)::DECIMAL(18,3) AS LMENG
FROM ({SQL_NEWEST_LINES}) newest""",
)
def k1_latest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = standins.schedule_lines(_t(spark, sf_dir, "lineitem"))
    return versions.latest_version(lines, ["VBELN", "POSNR"], "FILE_DATE", since=LINES_SINCE)


# ---------------------------------------------------------------------------
# K2 largest open orders, K4 their subtotals
# ---------------------------------------------------------------------------
def _sql_open(key: str, since: str) -> str:
    """Open orders (raw columns) by their newest version under ``key``."""
    return f"""
  SELECT * FROM ({_sql_orders(key, since)}) newest
  WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority <> '{CLOSED_STATUS}'"""


def _sql_k2(key: str, since: str, as_of: str) -> str:
    return f"""
SELECT {key} AS VBELN, order_day AS AUDAT, o_orderkey::VARCHAR AS AUART, o_custkey AS KUNNR,
       o_orderstatus AS LFSTK, o_orderpriority AS GBSTK, o_totalprice::DECIMAL(18,2) AS NETWR,
       o_orderpriority AS WAERK, (DATE '{as_of}' - order_day)::INTEGER AS ORDER_AGE_DAYS
FROM ({_sql_open(key, since)}) o WHERE order_day >= DATE '{CREATED_SINCE}'
ORDER BY NETWR DESC NULLS FIRST, VBELN, AUART LIMIT 20"""


SQL_K2 = _sql_k2("o_custkey", HEADER_SINCE, REPORT_AS_OF)


def _k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = standins.order_header(_t(spark, sf_dir, "orders"), key="o_custkey")
    return ord_ops.open_orders(
        header,
        as_of=REPORT_AS_OF,
        since=HEADER_SINCE,
        created_since=CREATED_SINCE,
        n=20,
        open_statuses=OPEN_STATUSES,
        closed_status=CLOSED_STATUS,
        tie_break=("VBELN", "AUART"),
    )


@register("k2_open_orders", oracle=SQL_K2)
def k2_open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _k2(spark, sf_dir)


@register(
    "k2_open_population",
    oracle=f"""
SELECT o_orderpriority AS WAERK, coalesce(sum(o_totalprice::DECIMAL(18,2)), 0)::DECIMAL(38,2) AS NET_TOTAL
FROM ({_sql_open("o_custkey", HEADER_SINCE)}) o
WHERE order_day >= DATE '{CREATED_SINCE}' AND o_orderpriority IS NOT NULL GROUP BY ALL""",
)
def k2_open_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 over the whole open population (a separate, named result; the
    report's own subtotal covers only its top rows)."""
    header = standins.order_header(_t(spark, sf_dir, "orders"), key="o_custkey")
    population = ord_ops.open_headers(
        header, HEADER_SINCE, OPEN_STATUSES, CLOSED_STATUS
    ).filter(F.col("AUDAT") >= F.lit(CREATED_SINCE).cast("date"))
    return ord_ops.subtotals(population)


@register(
    "k4_subtotals",
    oracle=f"""
SELECT DISTINCT WAERK, (sum(coalesce(NETWR, 0)) OVER (PARTITION BY WAERK))::DECIMAL(38,2) AS NET_TOTAL
FROM ({SQL_K2}) top WHERE WAERK IS NOT NULL""",
)
def k4_subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ord_ops.subtotals(_k2(spark, sf_dir))


@register(
    "k4_row_count",
    oracle=f"SELECT count(VBELN) AS ROWS FROM ({SQL_K2}) top",
)
def k4_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ord_ops.row_count(_k2(spark, sf_dir))


# ---------------------------------------------------------------------------
# K3 overdue schedule lines of open orders
# ---------------------------------------------------------------------------
SQL_K3 = f"""
SELECT l_orderkey AS VBELN, l_linenumber AS POSNR, order_day AS AUDAT, ship_day AS EDATU,
       l_quantity::DECIMAL(18,3) AS WMENG,
       l_quantity::DECIMAL(18,3) - (l_discount * 100)::DECIMAL(18,3) AS REMAIN_QTY,
       (DATE '{DELAY_AS_OF}' - ship_day)::INTEGER AS DELAY_DAYS, o_custkey AS KUNNR,
       o_totalprice::DECIMAL(18,2) AS NETWR, o_orderpriority AS WAERK, o_orderkey::VARCHAR AS AUART
FROM ({SQL_NEWEST_LINES}) line INNER JOIN ({_sql_open("o_orderkey", LINES_SINCE)}) o ON o_orderkey = l_orderkey
WHERE ship_day < DATE '{DELAY_AS_OF}' AND l_quantity > 0
  AND l_quantity::DECIMAL(18,3) > (l_discount * 100)::DECIMAL(18,3)
ORDER BY DELAY_DAYS DESC, ALL_REST LIMIT 20""".replace(
    "ALL_REST", "VBELN, POSNR, AUDAT, EDATU, WMENG, REMAIN_QTY, KUNNR, NETWR, WAERK, AUART"
)


def _k3(spark: SparkSession, sf_dir: str, n: int, **how) -> DataFrame:
    header = standins.order_header(_t(spark, sf_dir, "orders"), key="o_orderkey")
    lines = standins.schedule_lines(_t(spark, sf_dir, "lineitem"))
    return ord_ops.delayed_lines(
        header, lines, as_of=DELAY_AS_OF, since=LINES_SINCE, n=n,
        open_statuses=OPEN_STATUSES, closed_status=CLOSED_STATUS, **how,
    )


@register("k3_delayed_lines", oracle=SQL_K3)
def k3_delayed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _k3(spark, sf_dir, 20)


@register("k3_delayed_lines_reduced", oracle=SQL_K3)
def k3_delayed_lines_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 with the lines filtered by the open orders' keys before their version pick."""
    return _k3(spark, sf_dir, 20, filter_bits=22)


@register("k3_delayed_lines_hotkeys", oracle=SQL_K3)
def k3_delayed_lines_hotkeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 with salting: each order's lines are spread over 4 tasks."""
    return _k3(spark, sf_dir, 20, salts=4)


# ---------------------------------------------------------------------------
# K5 the digest as text lines. The oracle states the layout itself: titles,
# widths, row order.
# ---------------------------------------------------------------------------
def _sql_digest() -> str:
    cell = lambda e, w, side="rpad", fill=" ": f"{side}({e}, greatest({w}, length({e}))::INTEGER, '{fill}')"
    text = lambda e: f"coalesce({e}::VARCHAR, '')"
    number = lambda e: f"coalesce(format('{{:,.0f}}', {e}), '')"
    open_line = " || ' ' || ".join([
        cell(text("VBELN"), 12), cell(text("AUDAT"), 12), cell(text("AUART"), 6),
        cell("CASE LFSTK WHEN 'O' THEN 'Not delivered' ELSE 'Partly delivered' END", 8),
        cell(number("NETWR"), 12, "lpad"), cell(text("WAERK"), 5), cell(text("ORDER_AGE_DAYS || 'd'"), 4, "lpad"),
    ])
    late_line = " || ' ' || ".join([
        cell(text("VBELN"), 12), cell(cell(text("POSNR"), 5, "lpad", "0"), 6), cell(text("AUDAT"), 12), cell(text("EDATU"), 12),
        cell(number("REMAIN_QTY"), 8, "lpad"), cell(text("DELAY_DAYS || 'd'"), 4, "lpad"),
    ])
    return f"""
WITH top AS ({_sql_k2("o_orderkey", LINES_SINCE, DELAY_AS_OF)}),
late AS ({SQL_K3}),
cur AS (SELECT WAERK, coalesce(sum(NETWR), 0) AS AMT FROM top WHERE WAERK IS NOT NULL GROUP BY WAERK),
parts AS (
  SELECT 0 AS SECTION, 1 AS PART, 0 AS R, '*[Open sales orders] as of {DELAY_AS_OF}*' AS LINE
  UNION ALL SELECT 0, 2, 0, 'Total ' || count(*) || ' (top 20 by amount)' FROM top
  UNION ALL SELECT 0, 3, row_number() OVER (ORDER BY WAERK), '  Total(' || WAERK || '): ' || {number("AMT")} FROM cur
  UNION ALL SELECT 0, 4, 0, ''
  UNION ALL SELECT 0, 5, 0, '```'
  UNION ALL SELECT 0, 6, 0, 'Order        Date         Type   Status         Amount Cur     Age'
  UNION ALL SELECT 0, 7, 0, repeat('-', 65)
  UNION ALL SELECT 0, 8, row_number() OVER (ORDER BY NETWR DESC NULLS FIRST, VBELN, AUART), {open_line} FROM top
  UNION ALL SELECT 0, 9, 0, '```'
  UNION ALL SELECT 1, 1, 0, '*[Overdue schedule lines] as of {DELAY_AS_OF}*'
  UNION ALL SELECT 1, 2, 0, CASE count(*) WHEN 0 THEN 'No overdue lines' ELSE 'Total ' || count(*) || ' (by days late)' END FROM late
  UNION ALL SELECT 1, 3 + k, 0, s FROM (VALUES (0, ''), (1, '```'),
      (2, 'Order        Item   Date         Requested    Open qty  Late'), (3, repeat('-', 65)), (5, '```')) f(k, s)
    WHERE EXISTS (FROM late)
  UNION ALL SELECT 1, 7, row_number() OVER (ORDER BY DELAY_DAYS DESC, VBELN, POSNR, AUDAT, EDATU), {late_line} FROM late)
SELECT SECTION, (row_number() OVER (PARTITION BY SECTION ORDER BY PART, R))::INTEGER AS POS, LINE FROM parts"""


@register("k5_digest_lines", oracle=_sql_digest())
def k5_digest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole daily run on one header table and one day."""
    return dg.daily_digest(
        standins.order_header(_t(spark, sf_dir, "orders"), key="o_orderkey"),
        standins.schedule_lines(_t(spark, sf_dir, "lineitem")),
        as_of=DELAY_AS_OF, since=LINES_SINCE, created_since=CREATED_SINCE, n=20, delayed_n=20,
        open_statuses=OPEN_STATUSES, closed_status=CLOSED_STATUS, not_delivered="O",
    )


# ---------------------------------------------------------------------------
# K6-K9 keyword rules over product descriptions
# ---------------------------------------------------------------------------
def _has(column: str, *terms: str) -> str:
    """SQL: the upper-cased column contains one of the terms."""
    return "(" + " OR ".join(f"contains(upper({column}), '{w}')" for w in terms) + ")"


def _sql_keywords(source: str, cond: str, with_max: bool = False, tail: str = "") -> str:
    """Groups of a table whose text meets ``cond``: products and text samples."""
    key, group, text = SQL_SOURCES[source]
    biggest = f", max({text}) AS SAMPLE2" if with_max else ""
    return f"""
SELECT {group} AS MATKL, count(DISTINCT {key}) AS CNT, min({text}) AS SAMPLE1{biggest}
FROM {source.split(":")[0]} WHERE {cond} GROUP BY ALL {tail}"""


# Table (and view of it) -> product, group and text columns.
SQL_SOURCES = {
    "documents": ("doc_id", "source", "text"),
    "part:type": ("p_partkey", "p_type", "p_name"),
    "part:brand": ("p_partkey", "p_brand", "p_name"),
}


# Stand-in keyword rules (terms that occur in the test documents / part names).
RULE_LICENSE = (
    kw.clause("LICENSE", ("MIT", "APACHE"))
    | kw.clause("WORTHLESS")
    | kw.clause("@", ("COM", "ORG", "NET"))
    | kw.clause("RELEASED", "UNDER")
)
SQL_RULE_LICENSE = "(" + " OR ".join([
    _has("text", "LICENSE") + " AND " + _has("text", "MIT", "APACHE"),
    _has("text", "WORTHLESS"),
    _has("text", "@") + " AND " + _has("text", "COM", "ORG", "NET"),
    _has("text", "RELEASED") + " AND " + _has("text", "UNDER"),
]) + ")"
RULE_FR = kw.any_of("QUE", "POUR") & kw.any_of("MENT", "TION")
SQL_RULE_FR = _has("text", "QUE", "POUR") + " AND " + _has("text", "MENT", "TION")
RULE_THE = kw.clause("THE", ("TION", "ING"))
SQL_RULE_THE = _has("text", "THE") + " AND " + _has("text", "TION", "ING")
EXCLUDED_SOURCES = ("src0", "src1", "src2", "src3", "src4")
RULE_RING_GEAR = kw.any_of("RING", "GEAR")
SQL_RULE_RING_GEAR = _has("p_name", "RING", "GEAR")
RULE_HOT_COLD = kw.clause(("HOT", "COLD"), ("GEAR", "ROD"))
SQL_RULE_HOT_COLD = _has("p_name", "HOT", "COLD") + " AND " + _has("p_name", "GEAR", "ROD")
INCLUDED_BRANDS = ("Brand#1", "Brand#12", "Brand#13", "Brand#21")
PROFILE_BRANDS = ("Brand#12", "Brand#21", "Brand#3", "Brand#7")


def _docs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = _t(spark, sf_dir, "documents")
    return standins.document_products(documents), standins.document_texts(documents)


def _parts(spark: SparkSession, sf_dir: str, group: str = "p_type") -> tuple[DataFrame, DataFrame]:
    part = _t(spark, sf_dir, "part")
    return standins.products(part, group), standins.product_texts(part)


@register(
    "k6_keyword_groups",
    oracle=_sql_keywords("documents", f"lang = 'en' AND {SQL_RULE_LICENSE}"),
)
def k6_keyword_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    products, texts = _docs(spark, sf_dir)
    return kw.keyword_groups(products, texts, RULE_LICENSE, lang="en")


@register(
    "k6_keyword_groups_family",
    oracle=_sql_keywords("documents", f"lang = 'fr' AND {SQL_RULE_FR} AND {_has('source', '1')}", with_max=True),
)
def k6_keyword_groups_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    products, texts = _docs(spark, sf_dir)
    return kw.keyword_groups(
        products, texts, RULE_FR, lang="fr", group_contains="1", with_max=True
    )


@register(
    "k6_keyword_groups_excluding",
    oracle=_sql_keywords(
        "documents",
        f"lang = 'en' AND {SQL_RULE_THE} AND source NOT IN {EXCLUDED_SOURCES}",
        tail="ORDER BY CNT DESC, MATKL LIMIT 10",
    ),
)
def k6_keyword_groups_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    products, texts = _docs(spark, sf_dir)
    return kw.keyword_groups(
        products, texts, RULE_THE, lang="en", exclude=EXCLUDED_SOURCES, n=10
    )


@register(
    "k6_keyword_groups_including",
    oracle=_sql_keywords(
        "part:brand", f"p_brand IN {INCLUDED_BRANDS} AND starts_with(p_brand, 'Brand#1') AND {SQL_RULE_HOT_COLD}"
    ),
)
def k6_keyword_groups_including(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A known list of groups, cut to those with a prefix."""
    products, texts = _parts(spark, sf_dir, "p_brand")
    return kw.keyword_groups(
        products, texts, RULE_HOT_COLD, lang=None, include=INCLUDED_BRANDS, group_prefix="Brand#1"
    )


@register(
    "k7_group_profile",
    oracle=_sql_keywords("part:brand", f"p_brand IN {PROFILE_BRANDS}", with_max=True),
)
def k7_group_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    products, texts = _parts(spark, sf_dir, "p_brand")
    return kw.group_profile(products, texts, lang=None, groups=PROFILE_BRANDS)


@register(
    "k7_group_prefix",
    oracle=_sql_keywords("part:brand", "starts_with(p_brand, 'Brand#1')"),
)
def k7_group_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    products, texts = _parts(spark, sf_dir, "p_brand")
    return kw.group_profile(products, texts, lang=None, prefix="Brand#1", with_max=False)


@register(
    "k8_keyword_samples",
    oracle=f"""
SELECT p_name AS MAKTX, p_type AS MATKL, p_partkey AS MATNR FROM part
WHERE p_type = 'PROMO' AND {SQL_RULE_RING_GEAR} ORDER BY ALL LIMIT 30""",
)
def k8_keyword_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    products, texts = _parts(spark, sf_dir)
    return kw.keyword_samples(products, texts, RULE_RING_GEAR, lang=None, group="PROMO", n=30)


@register(
    "k8_keyword_samples_by_group",
    oracle=f"""
SELECT p_name AS MAKTX, p_type AS MATKL, p_partkey AS MATNR FROM part
WHERE {SQL_RULE_HOT_COLD} ORDER BY p_type, p_name, p_partkey LIMIT 50""",
)
def k8_keyword_samples_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    products, texts = _parts(spark, sf_dir)
    return kw.keyword_samples(
        products, texts, RULE_HOT_COLD, lang=None, n=50, order=("MATKL", "MAKTX")
    )


@register(
    "k8_group_samples",
    oracle="""
SELECT p_name AS MAKTX, p_type AS MATKL, p_partkey AS MATNR FROM part
WHERE p_type = 'SMALL' ORDER BY ALL LIMIT 50""",
)
def k8_group_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every description of one group (no rule), first 50 by text."""
    products, texts = _parts(spark, sf_dir)
    return kw.keyword_samples(products, texts, None, lang=None, group="SMALL", n=50)


@register(
    "k9_keyword_split",
    oracle=f"""
SELECT if({SQL_RULE_RING_GEAR}, 'Match', 'Other') AS TYPE, count(DISTINCT p_partkey) AS CNT, min(p_name) AS SAMPLE
FROM part WHERE p_type = 'PROMO' GROUP BY ALL""",
)
def k9_keyword_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    products, texts = _parts(spark, sf_dir)
    return kw.keyword_split(products, texts, RULE_RING_GEAR, lang=None, group="PROMO")


@register(
    "k9_keyword_split_documents",
    oracle=f"""
SELECT if({SQL_RULE_LICENSE}, 'Match', 'Other') AS TYPE, count(DISTINCT doc_id) AS CNT
FROM documents WHERE lang = 'en' AND source = 'src7' GROUP BY ALL""",
)
def k9_keyword_split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    products, texts = _docs(spark, sf_dir)
    return kw.keyword_split(
        products, texts, RULE_LICENSE, lang="en", group="src7", with_sample=False
    )


# Five searches over one text table, as one file of the reference asks them.
SEARCHES = {
    "excluding": kw.Search(RULE_THE, exclude=EXCLUDED_SOURCES),
    "family": kw.Search(RULE_THE, group_contains="1"),
    "license": kw.Search(RULE_LICENSE),
    "listed": kw.Search(None, include=("src7", "src8"), group_prefix="src"),
    "names": kw.Search(kw.any_of("@", "WORTHLESS")),
}
SQL_SEARCHES = {
    "excluding": f"{SQL_RULE_THE} AND source NOT IN {EXCLUDED_SOURCES}",
    "family": f"{SQL_RULE_THE} AND {_has('source', '1')}",
    "license": SQL_RULE_LICENSE,
    "listed": "source IN ('src7', 'src8') AND starts_with(source, 'src')",
    "names": _has("text", "@", "WORTHLESS"),
}


@register(
    "k6_keyword_rules",
    oracle=" UNION ALL ".join(
        f"SELECT '{name}' AS SEARCH, g.* FROM ({_sql_keywords('documents', f'lang = {chr(39)}en{chr(39)} AND {cond}', with_max=True)}) g"
        for name, cond in SQL_SEARCHES.items()
    ),
)
def k6_keyword_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five searches, the texts read and folded once."""
    products, texts = _docs(spark, sf_dir)
    return kw.keyword_rules(products, texts, SEARCHES, lang="en")


@register(
    "k8_keyword_rule_samples",
    oracle=" UNION ALL ".join(
        f"(SELECT '{name}' AS SEARCH, row_number() OVER (ORDER BY text, source, doc_id)::INTEGER AS POS, text AS MAKTX,"
        f" source AS MATKL, doc_id AS MATNR FROM documents WHERE lang = 'en' AND {cond} QUALIFY POS <= 30)"
        for name, cond in SQL_SEARCHES.items()
    ),
)
def k8_keyword_rule_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 texts of each search, the texts read and folded once."""
    products, texts = _docs(spark, sf_dir)
    return kw.keyword_rule_samples(products, texts, SEARCHES, lang="en", n=30)


# ---------------------------------------------------------------------------
# K10 monthly invoiced sales, K11 load-date distribution, K12 duplicate keys
# ---------------------------------------------------------------------------
SALES_GRAIN = "year"            # yearly loads: ship year / order year
EXCLUDED_TYPES = ("1-URGENT", "2-HIGH")
SALES_CURRENCY = "F"
SALES_SINCE = "1996-01-01"
SALES_GROUPS = ("PROMO", "SMALL")
EXTRACT_MIN_NET = 0             # line net amount > 0, the reference's own test
SLICE_LO, SLICE_HI = "1996-03", "1997-02"
SLICE_CATS = ("Promo", "Small")
SERIES_CATS = ("Promo", "Small", "Nonexistent")   # a category with no rows: zero cells
PIVOT_CATS = ("Promo", "Small", "Nonexistent")


# Invoice facts over the raw tables: a line meets its document's header if both
# are of one yearly load.
SQL_FACTS = f"""
  FROM lineitem
  INNER JOIN orders ON o_orderkey = l_orderkey AND year(o_orderdate) = year(l_shipdate)
  INNER JOIN part ON p_partkey = l_partkey
  WHERE o_orderpriority NOT IN {EXCLUDED_TYPES} AND o_orderstatus = '{SALES_CURRENCY}'
    AND CAST(o_orderdate AS DATE) >= DATE '{SALES_SINCE}' AND l_extendedprice > 0"""
SQL_SUMS = (
    "sum(l_quantity::DECIMAL(18,3))::DECIMAL(38,3) AS QTY, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(38,2) AS NET_USD"
)
SQL_MONTH = "strftime(o_orderdate, '%Y-%m') AS YEARMONTH"
SQL_NEWEST_LOAD = "AND year(l_shipdate) = (SELECT max(year(l_shipdate)) FROM lineitem)"


def _sql_monthly(groups, by_group: bool, newest: bool) -> str:
    group = "p_type AS MATKL, " if by_group else ""
    chosen = " OR ".join(f"p_type = '{g}'" for g in groups)
    return f"""
SELECT {group}{SQL_MONTH}, {SQL_SUMS} {SQL_FACTS} AND ({chosen}) {SQL_NEWEST_LOAD if newest else ""} GROUP BY ALL"""


def _monthly(spark, sf_dir, by_group, groups, snapshot, min_net=0, grain=SALES_GRAIN, **how) -> DataFrame:
    return sales.monthly_sales(
        standins.invoice_lines(_t(spark, sf_dir, "lineitem"), grain),
        standins.invoice_headers(_t(spark, sf_dir, "orders"), grain),
        standins.products(_t(spark, sf_dir, "part")),
        by_group=by_group,
        groups=groups,
        snapshot=snapshot,
        exclude_types=EXCLUDED_TYPES,
        currency=SALES_CURRENCY,
        since=SALES_SINCE,
        min_net=min_net,
        **how,
    )


@register("k10_monthly_sales_by_size", oracle=_sql_monthly(SALES_GROUPS, True, False))
def k10_monthly_sales_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10 with the join order taken from counted dimensions."""
    return _monthly(spark, sf_dir, True, SALES_GROUPS, "paired", join_order="size")


@register("k10_monthly_sales_reduced", oracle=_sql_monthly(SALES_GROUPS, True, False))
def k10_monthly_sales_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10 with the lines filtered by the keys of both dimensions before the joins."""
    return _monthly(spark, sf_dir, True, SALES_GROUPS, "paired", filter_bits=22)


@register("k10_monthly_sales_paired", oracle=_sql_monthly(SALES_GROUPS, True, False))
def k10_monthly_sales_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir, True, SALES_GROUPS, "paired")


@register("k10_monthly_sales_paired_hotkeys", oracle=_sql_monthly(SALES_GROUPS, True, False))
def k10_monthly_sales_paired_hotkeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10 with salting: each document's and product's lines are spread over 4 tasks."""
    return _monthly(spark, sf_dir, True, SALES_GROUPS, "paired", salts=4)


@register("k10_monthly_sales_latest", oracle=_sql_monthly(SALES_GROUPS, True, True))
def k10_monthly_sales_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir, True, SALES_GROUPS, "global_latest")


@register("k10_monthly_sales_one_group", oracle=_sql_monthly(["PROMO"], False, True))
def k10_monthly_sales_one_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir, False, ("PROMO",), "global_latest")


@register("k10_monthly_sales_paired_one_group", oracle=_sql_monthly(["PROMO"], False, False))
def k10_monthly_sales_paired_one_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir, False, ("PROMO",), "paired")


@register(
    "k11_version_distribution",
    oracle="""
SELECT CAST(l_shipdate AS DATE) AS FILE_DATE, count(*) AS ROW_CNT,
       sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(38,2) AS NET_USD
FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') GROUP BY ALL""",
)
def k11_version_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = standins.invoice_lines(_t(spark, sf_dir, "lineitem"), "day")
    products = standins.products(_t(spark, sf_dir, "part"))
    return versions.version_distribution(lines, products, "PROMO")


def _sql_repeated(cond: str) -> str:
    """Line keys that are there more than once, by counting over a window."""
    return f"""
SELECT DISTINCT l_orderkey AS VBELN, l_linenumber AS POSNR, count(*) OVER w AS DUP_CNT,
       CAST(min(l_shipdate) OVER w AS DATE) AS FIRST_DATE, CAST(max(l_shipdate) OVER w AS DATE) AS LAST_DATE
FROM lineitem WHERE {cond} WINDOW w AS (PARTITION BY l_orderkey, l_linenumber) QUALIFY DUP_CNT >= 2"""


@register(
    "k12_duplicate_keys",
    oracle=f"""
SELECT * FROM ({_sql_repeated("l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')")}) r
ORDER BY DUP_CNT DESC, VBELN, POSNR LIMIT 10""",
)
def k12_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = standins.invoice_lines(_t(spark, sf_dir, "lineitem"), "day")
    products = standins.products(_t(spark, sf_dir, "part"))
    return versions.duplicate_keys(lines, ("VBELN", "POSNR"), products=products, group="PROMO", n=10)


@register("k12_duplicate_keys_all", oracle=_sql_repeated("true"))
def k12_duplicate_keys_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = standins.invoice_lines(_t(spark, sf_dir, "lineitem"), "day")
    return versions.duplicate_keys(lines, ("VBELN", "POSNR"), n=None)


# ---------------------------------------------------------------------------
# K13 the month x category extract and K14-K17 dashboard slices over it
# ---------------------------------------------------------------------------
SQL_EXTRACT_CTES = f"""WITH extract AS (
  SELECT {SQL_MONTH}, upper(p_type[1]) || lower(p_type[2:]) AS CATEGORY, {SQL_SUMS} {SQL_FACTS} GROUP BY ALL)"""

SQL_RANGE = f"r AS (SELECT * FROM extract WHERE YEARMONTH BETWEEN '{SLICE_LO}' AND '{SLICE_HI}')"


SLICE = (SLICE_LO, SLICE_HI)


def _extract(spark: SparkSession, sf_dir: str, months: tuple[str, str] | None = None) -> DataFrame:
    """The extract in one aggregation (the dashboard jobs' input). A job that
    shows a range of months passes it down, as date bounds on the header scan."""
    return sales.category_sales(
        standins.invoice_lines(_t(spark, sf_dir, "lineitem"), SALES_GRAIN),
        standins.invoice_headers(_t(spark, sf_dir, "orders"), SALES_GRAIN),
        standins.products(_t(spark, sf_dir, "part")),
        standins.category_map(_t(spark, sf_dir, "part")),
        exclude_types=EXCLUDED_TYPES,
        currency=SALES_CURRENCY,
        since=SALES_SINCE,
        min_net=EXTRACT_MIN_NET,
        months=months,
    )


def _sql_money(e: str) -> str:
    v = f"CAST({e} AS DECIMAL(24,6))"
    return (
        f"CASE WHEN {v} >= 1000000 THEN '$' || CAST(CAST(ROUND({v} * CAST(0.000001 AS DECIMAL(7,6)), 2)"
        f" AS DECIMAL(38,2)) AS VARCHAR) || 'M'"
        f" WHEN {v} >= 1000 THEN '$' || format('{{:,}}', CAST(FLOOR({v} * CAST(0.001 AS DECIMAL(4,3))"
        f" + CAST(0.5 AS DECIMAL(2,1))) AS BIGINT)) || 'K'"
        f" ELSE '$' || format('{{:,}}', CAST(FLOOR({v} + CAST(0.5 AS DECIMAL(2,1))) AS BIGINT)) END"
    )


@register("k13_category_extract", oracle=SQL_EXTRACT_CTES + "\nSELECT * FROM extract")
def k13_category_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps: monthly sales per group, then rolled up to categories."""
    monthly = _monthly(spark, sf_dir, True, None, "paired", EXTRACT_MIN_NET)
    return sales.category_extract(monthly, standins.category_map(_t(spark, sf_dir, "part")))


@register("k13_category_sales", oracle=SQL_EXTRACT_CTES + "\nSELECT * FROM extract")
def k13_category_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass: products mapped to categories before the aggregation."""
    return _extract(spark, sf_dir)


@register(
    "k14_slice_kpis",
    oracle=SQL_EXTRACT_CTES + f""",
{SQL_RANGE},
k AS (
  SELECT CAST(COALESCE(SUM(CASE WHEN CATEGORY IN {SLICE_CATS} THEN QTY END), 0) AS DECIMAL(38,3)) AS TOTAL_QTY,
         CAST(COALESCE(SUM(CASE WHEN CATEGORY IN {SLICE_CATS} THEN NET_USD END), 0) AS DECIMAL(38,2)) AS TOTAL_AMOUNT,
         COUNT(DISTINCT YEARMONTH) AS N_MONTHS
  FROM r),
kp AS (
  SELECT *, CASE WHEN N_MONTHS > 0
      THEN CAST(CAST((CAST(TOTAL_AMOUNT * 100 AS HUGEINT) * 20000 + N_MONTHS) // (2 * N_MONTHS)
                     AS DECIMAL(30,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(38,6))
      ELSE CAST(0 AS DECIMAL(38,6)) END AS AVG_AMOUNT
  FROM k)
SELECT TOTAL_QTY, TOTAL_AMOUNT, N_MONTHS, AVG_AMOUNT,
       regexp_replace(regexp_replace(format('{{:,.3f}}', CAST(TOTAL_QTY AS DOUBLE)), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS QTY_TEXT,
       {_sql_money("TOTAL_AMOUNT")} AS AMOUNT_TEXT,
       {_sql_money("AVG_AMOUNT")} AS AVG_TEXT
FROM kp""",
)
def k14_slice_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dash.slice_kpis(_extract(spark, sf_dir, SLICE), SLICE_LO, SLICE_HI, SLICE_CATS)


def _sql_series(metric: str) -> str:
    col = "NET_USD" if metric == "amt" else "QTY"
    raw = f"COALESCE(SUM(r.{col}), 0)"
    plotted = f"FLOOR({raw} + CAST(0.5 AS DECIMAL(2,1)))" if metric == "amt" else raw
    cats = ", ".join(f"('{c}', {i})" for i, c in enumerate(SERIES_CATS))
    return SQL_EXTRACT_CTES + f""",
{SQL_RANGE},
months AS (SELECT DISTINCT YEARMONTH FROM r),
cats(CATEGORY, POS) AS (VALUES {cats}),
cells AS (
  SELECT m.YEARMONTH, c.CATEGORY, CAST(c.POS AS INTEGER) AS POS,
         CAST({plotted} AS DECIMAL(38,3)) AS VALUE
  FROM months m CROSS JOIN cats c
  LEFT JOIN r ON r.YEARMONTH = m.YEARMONTH AND r.CATEGORY = c.CATEGORY
  GROUP BY m.YEARMONTH, c.CATEGORY, c.POS)
SELECT YEARMONTH, CATEGORY, POS, VALUE,
       CAST(SUM(VALUE) OVER (PARTITION BY YEARMONTH) AS DECIMAL(38,3)) AS MONTH_TOTAL,
       {"'$' || " if metric == "amt" else ""}regexp_replace(regexp_replace(format('{{:,.3f}}', CAST(VALUE AS DOUBLE)),
           '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS VALUE_TEXT,
       '{"$" if metric == "amt" else ""}' || format('{{:,}}', CAST(FLOOR(SUM(VALUE) OVER (PARTITION BY YEARMONTH) + 0.5) AS BIGINT)) AS TOTAL_TEXT
FROM cells"""


@register("k15_dense_series", oracle=_sql_series("amt"))
def k15_dense_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dash.dense_series(_extract(spark, sf_dir, SLICE), SLICE_LO, SLICE_HI, SERIES_CATS, "amt")


@register("k15_dense_series_qty", oracle=_sql_series("qty"))
def k15_dense_series_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dash.dense_series(_extract(spark, sf_dir, SLICE), SLICE_LO, SLICE_HI, SERIES_CATS, "qty")


@register(
    "i10_axis_labels",
    oracle=f"""
WITH amt AS ({_sql_series("amt")}), qty AS ({_sql_series("qty")})
SELECT YEARMONTH, CATEGORY,
       CASE WHEN amt.VALUE >= 1000000 THEN '$' || round(amt.VALUE::DECIMAL(24,6) * 0.000001::DECIMAL(7,6), 1)::DECIMAL(38,1)::VARCHAR || 'M'
            ELSE '$' || round(amt.VALUE::DECIMAL(24,6) * 0.001::DECIMAL(4,3), 0)::BIGINT::VARCHAR || 'K' END AS AMT_LABEL,
       CASE WHEN qty.VALUE >= 1000 THEN round(qty.VALUE::DECIMAL(24,6) * 0.001::DECIMAL(4,3), 0)::BIGINT::VARCHAR || 'K'
            ELSE replace(qty.VALUE_TEXT, ',', '') END AS QTY_LABEL
FROM amt JOIN qty USING (YEARMONTH, CATEGORY)""",
)
def i10_axis_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axis text of every plotted value, in both metrics."""
    extract = _extract(spark, sf_dir, SLICE)
    amt = dash.dense_series(extract, SLICE_LO, SLICE_HI, SERIES_CATS, "amt")
    qty = dash.dense_series(extract, SLICE_LO, SLICE_HI, SERIES_CATS, "qty")
    return amt.select("YEARMONTH", "CATEGORY", axis_label("VALUE", "amt").alias("AMT_LABEL")).join(
        qty.select("YEARMONTH", "CATEGORY", axis_label("VALUE", "qty").alias("QTY_LABEL")), ["YEARMONTH", "CATEGORY"]
    )


def _sql_pivot_body(col: str, dec: str) -> str:
    cells = ",\n         ".join(
        f"CAST(COALESCE(SUM(CASE WHEN CATEGORY = '{c}' THEN {col} END), 0) AS {dec}) AS \"{c}\""
        for c in PIVOT_CATS
    )
    return SQL_EXTRACT_CTES + f""",
{SQL_RANGE},
body AS (
  SELECT YEARMONTH,
         {cells},
         CAST(COALESCE(SUM(CASE WHEN CATEGORY IN {PIVOT_CATS} THEN {col} END), 0) AS {dec}) AS TOTAL
  FROM r GROUP BY YEARMONTH),
piv AS (
  SELECT * FROM body
  UNION ALL
  SELECT 'TOTAL', {", ".join(f'CAST(COALESCE(SUM("{c}"), 0) AS {dec})' for c in PIVOT_CATS)},
         CAST(COALESCE(SUM(TOTAL), 0) AS {dec}) FROM body)"""


@register("k16_pivot_totals", oracle=_sql_pivot_body("NET_USD", "DECIMAL(38,2)") + "\nSELECT * FROM piv")
def k16_pivot_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dash.pivot_with_totals(_extract(spark, sf_dir, SLICE), SLICE_LO, SLICE_HI, PIVOT_CATS, "amt")


@register(
    "k16_pivot_totals_qty",
    oracle=_sql_pivot_body("QTY", "DECIMAL(38,3)") + "\nSELECT * FROM piv",
)
def k16_pivot_totals_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dash.pivot_with_totals(_extract(spark, sf_dir, SLICE), SLICE_LO, SLICE_HI, PIVOT_CATS, "qty")


@register("k16_pivot_grouping_sets", oracle=_sql_pivot_body("NET_USD", "DECIMAL(38,2)") + "\nSELECT * FROM piv")
def k16_pivot_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pivot with totals from one rollup."""
    return totals.pivot_by_grouping_sets(_extract(spark, sf_dir, SLICE), SLICE_LO, SLICE_HI, PIVOT_CATS, "amt")


@register(
    "a17_cube_totals",
    oracle=SQL_EXTRACT_CTES + """
SELECT if(grouping(YEARMONTH) = 1, 'TOTAL', YEARMONTH) AS YEARMONTH, if(grouping(CATEGORY) = 1, 'TOTAL', CATEGORY) AS CATEGORY,
       sum(QTY)::DECIMAL(38,3) AS QTY, sum(NET_USD)::DECIMAL(38,2) AS NET_USD, grouping_id(YEARMONTH, CATEGORY) AS LEVEL
FROM extract GROUP BY CUBE (YEARMONTH, CATEGORY)""",
)
def a17_cube_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, month totals, category totals and the grand total of the extract."""
    return totals.grouping_totals(
        _extract(spark, sf_dir), ["YEARMONTH", "CATEGORY"], {"QTY": "QTY", "NET_USD": "NET_USD"}, "cube", "TOTAL"
    )


def _sql_shown(e: str, prefix: str = "$") -> str:
    return f"'{prefix}' || format('{{:,}}', CAST(FLOOR({e} + CAST(0.5 AS DECIMAL(2,1))) AS BIGINT))"


@register(
    "k16_pivot_display",
    oracle=_sql_pivot_body("NET_USD", "DECIMAL(38,2)")
    + "\nSELECT YEARMONTH, "
    + ", ".join(
        f"CASE WHEN YEARMONTH = 'TOTAL' OR \"{c}\" > 0 THEN {_sql_shown(chr(34) + c + chr(34))} ELSE '-' END AS \"{c}\""
        for c in PIVOT_CATS
    )
    + f", {_sql_shown('TOTAL')} AS TOTAL FROM piv",
)
def k16_pivot_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivot = dash.pivot_with_totals(_extract(spark, sf_dir, SLICE), SLICE_LO, SLICE_HI, PIVOT_CATS, "amt")
    return dash.pivot_display(pivot, PIVOT_CATS, "amt")


@register(
    "k16_pivot_display_qty",
    oracle=_sql_pivot_body("QTY", "DECIMAL(38,3)")
    + "\nSELECT YEARMONTH, "
    + ", ".join(
        f"CASE WHEN YEARMONTH = 'TOTAL' OR \"{c}\" > 0 THEN {_sql_shown(chr(34) + c + chr(34), '')} ELSE '-' END AS \"{c}\""
        for c in PIVOT_CATS
    )
    + f", {_sql_shown('TOTAL', '')} AS TOTAL FROM piv",
)
def k16_pivot_display_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivot = dash.pivot_with_totals(_extract(spark, sf_dir, SLICE), SLICE_LO, SLICE_HI, PIVOT_CATS, "qty")
    return dash.pivot_display(pivot, PIVOT_CATS, "qty")


@register(
    "k17_default_range",
    oracle=SQL_EXTRACT_CTES + """,
months AS (SELECT DISTINCT YEARMONTH FROM extract)
SELECT (SELECT MIN(YEARMONTH) FROM months) AS LO,
       (SELECT YEARMONTH FROM months ORDER BY YEARMONTH DESC LIMIT 1 OFFSET 1) AS HI""",
)
def k17_default_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dash.default_range(_extract(spark, sf_dir))


# ---------------------------------------------------------------------------
# K18 catalog lookups
# ---------------------------------------------------------------------------
@register("k18_distinct_values", oracle="SELECT DISTINCT lang FROM documents LIMIT 20")
def k18_distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_values(_t(spark, sf_dir, "documents"), "lang", 20)


@register(
    "k18_dictionary",
    oracle="SELECT * FROM nation WHERE n_regionkey = 1 ORDER BY n_name",
)
def k18_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary(_t(spark, sf_dir, "nation"), 1, table_col="n_regionkey", order_col="n_name")


@register(
    "k18_preview",
    oracle="SELECT least(3, count(*)) AS PREVIEW_ROWS, least(3, count(*)) AS FOUND_ROWS FROM documents",
)
def k18_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preview gives any 3 rows; checked are their number and that each is
    a row of the table. The three go to the scan as a broadcast; the table is
    not shuffled."""
    documents = _t(spark, sf_dir, "documents").select("doc_id", "text")
    shown = preview(documents, 3).select(F.monotonically_increasing_id().alias("row"), F.struct("doc_id", "text").alias("shown"))
    same = F.col("doc_id").eqNullSafe(F.col("shown.doc_id")) & F.col("text").eqNullSafe(F.col("shown.text"))
    found = documents.join(F.broadcast(shown), same)
    counted = shown.select("row", F.lit(0).alias("there")).union(found.select("row", F.lit(1).alias("there")))
    return counted.agg(
        F.count_distinct(F.when(F.col("there") == 0, F.col("row"))).alias("PREVIEW_ROWS"),
        F.count_distinct(F.when(F.col("there") == 1, F.col("row"))).alias("FOUND_ROWS"),
    )


@register(
    "s2_sql_text",
    oracle=f"""
SELECT o_orderstatus AS LFSTK, count(*) AS N, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(38,2) AS NETWR
FROM orders WHERE o_orderdate >= TIMESTAMP '{CREATED_SINCE}' GROUP BY ALL""",
)
def s2_sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL text over a named view with a bound argument."""
    header = standins.order_header(_t(spark, sf_dir, "orders"), key="o_orderkey")
    return run_sql(
        spark,
        "SELECT LFSTK, COUNT(*) AS N, CAST(SUM(NETWR) AS DECIMAL(38,2)) AS NETWR "
        "FROM salesloom_vbak WHERE AUDAT >= CAST(:since AS DATE) GROUP BY LFSTK",
        views={"salesloom_vbak": header},
        args={"since": CREATED_SINCE},
    )


@register(
    "i14_category_labels",
    oracle=SQL_EXTRACT_CTES + """,
lab AS (SELECT DISTINCT UPPER(SUBSTR(p_type, 1, 1)) || LOWER(SUBSTR(p_type, 2)) AS CATEGORY,
               UPPER(SUBSTR(p_type, 1, 1)) || LOWER(SUBSTR(p_type, 2)) || ' (' || p_type || ')' AS LABEL
        FROM part)
SELECT e.YEARMONTH, e.CATEGORY, e.QTY, e.NET_USD, COALESCE(lab.LABEL, e.CATEGORY) AS LABEL
FROM extract e LEFT JOIN lab ON e.CATEGORY = lab.CATEGORY""",
)
def i14_category_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = standins.category_labels(_t(spark, sf_dir, "part"))
    return dash.label_categories(_extract(spark, sf_dir), labels)
