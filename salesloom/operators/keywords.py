"""Keyword rules over product descriptions (F10-F13) and the searches built
on them: matching groups (K6), group profiles (K7), matching samples (K8) and
a two-way split (K9).

A rule is an OR of clauses; a clause is an AND of term sets; a term set
matches when the upper-cased text contains any of its terms as a substring
(``RING`` also hits ``STRING``, as ``UPPER(x) LIKE '%RING%'`` does). Keywords
are data: pass them in, they are not fixed here.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions.ordering import ascending, descending


@dataclass(frozen=True)
class Clause:
    """AND over term sets; each set is an OR of substrings."""

    sets: tuple[tuple[str, ...], ...]

    def column(self, folded: Column) -> Column:
        parts = [
            reduce(lambda a, b: a | b, [folded.contains(term) for term in alternatives])
            for alternatives in self.sets
        ]
        return reduce(lambda a, b: a & b, parts)


@dataclass(frozen=True)
class Rule:
    """OR over clauses."""

    clauses: tuple[Clause, ...]

    def column(self, text: Column | str) -> Column:
        """The rule as one boolean Column over ``upper(text)``.

        The folded text is bound once per row as the variable of a
        one-element ``exists``: a filter gets no common-subexpression
        elimination, so writing ``upper(text)`` into every term would fold a
        long text once per term (measured 1.6x slower with ten terms).

        NULL text gives NULL, which a filter treats as no match and a CASE
        sends to its ELSE branch.
        """
        raw = F.col(text) if isinstance(text, str) else text
        return F.exists(
            F.array(F.upper(raw)),
            lambda folded: reduce(lambda a, b: a | b, [c.column(folded) for c in self.clauses]),
        )

    def __or__(self, other: "Rule") -> "Rule":
        return Rule(self.clauses + other.clauses)

    def __and__(self, other: "Rule") -> "Rule":
        return Rule(
            tuple(Clause(a.sets + b.sets) for a in self.clauses for b in other.clauses)
        )


def clause(*sets: str | Iterable[str]) -> Rule:
    """A one-clause rule: every argument must match; a tuple/list argument
    matches when any of its terms does. ``clause("RED", ("RING", "GEAR"))``
    is ``RED AND (RING OR GEAR)``."""
    norm = tuple(
        (s.upper(),) if isinstance(s, str) else tuple(t.upper() for t in s) for s in sets
    )
    if not norm or any(not alternatives for alternatives in norm):
        raise ValueError("a clause needs at least one term in every set")
    return Rule((Clause(norm),))


def any_of(*terms: str) -> Rule:
    """Matches when any term occurs."""
    return clause(tuple(terms))


def any_rule(*rules: Rule) -> Rule:
    """OR of rules."""
    return reduce(lambda a, b: a | b, rules)


def _described(
    products: DataFrame,
    texts: DataFrame,
    lang: str | None,
    material: str,
    group_col: str,
    lang_col: str,
    text_col: str,
) -> DataFrame:
    """Products joined to their description in one language.

    One row per product only if (material, language) is unique in ``texts``.
    Filters on the text or group are pushed by Catalyst to their own side
    before the join, so only matching descriptions are shuffled.
    """
    if lang is not None:
        texts = texts.filter(F.col(lang_col) == lang)
    return products.select(material, group_col).join(
        texts.select(material, text_col), on=material, how="inner"
    )


def _group_filter(
    df: DataFrame,
    group_col: str,
    include: Sequence[str] | None,
    exclude: Sequence[str] | None,
    contains: str | None,
    prefix: str | None,
) -> DataFrame:
    g = F.col(group_col)
    if include is not None:
        df = df.filter(g.isin(list(include)))
    if exclude is not None:
        df = df.filter(~g.isin(list(exclude)))  # NULL group is dropped, as NOT IN does
    if contains is not None:
        df = df.filter(F.upper(g).contains(contains.upper()))
    if prefix is not None:
        df = df.filter(g.startswith(prefix))  # case-sensitive, as LIKE 'P%'
    return df


def _counted(
    df: DataFrame,
    group_col: str,
    material: str,
    text_col: str,
    least: str | None,
    greatest: str | None = None,
) -> DataFrame:
    """Per group: ``CNT`` distinct products, and the smallest and largest text
    under the names given.

    A count-distinct groups by (group, product) first, where hardly any two
    rows meet, so a text aggregated beside it would be carried along whole for
    every product. Here a row is taken apart into (product, no text) and (no
    product, text): the texts of a group then meet in one key and are combined
    before the shuffle.
    """
    kind, text_kind = df.schema[material].dataType, df.schema[text_col].dataType
    if least is None and greatest is None:
        return df.groupBy(group_col).agg(F.count_distinct(material).alias("CNT"))
    halves = F.array(
        F.struct(F.col(material).alias("_m"), F.lit(None).cast(text_kind).alias("_t")),
        F.struct(F.lit(None).cast(kind).alias("_m"), F.col(text_col).alias("_t")),
    )
    per_product = (
        df.select(F.col(group_col).alias("_g"), F.explode(halves).alias("_h"))
        .groupBy("_g", F.col("_h._m").alias("_m"))
        .agg(F.min("_h._t").alias("_lo"), F.max("_h._t").alias("_hi"))
    )
    out = [F.count("_m").alias("CNT")]
    out += [F.min("_lo").alias(least)] if least else []
    out += [F.max("_hi").alias(greatest)] if greatest else []
    return per_product.groupBy(F.col("_g").alias(group_col)).agg(*out)


def keyword_groups(
    products: DataFrame,
    texts: DataFrame,
    rule: Rule | None,
    lang: str | None = D.TEXT_LANGUAGE,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
    group_contains: str | None = None,
    group_prefix: str | None = None,
    n: int | None = None,
    with_max: bool = False,
    material: str = "MATNR",
    group_col: str = "MATKL",
    lang_col: str = "SPRAS",
    text_col: str = "MAKTX",
) -> DataFrame:
    """K6: product groups with descriptions matching ``rule``.

    Result: ``MATKL, CNT`` (distinct products), ``SAMPLE1`` (smallest matching
    text) and, with ``with_max``, ``SAMPLE2`` (largest); most products first,
    then by group; the first ``n`` when given.
    """
    df = _described(products, texts, lang, material, group_col, lang_col, text_col)
    df = _group_filter(df, group_col, include, exclude, group_contains, group_prefix)
    if rule is not None:
        df = df.filter(rule.column(text_col))
    out = _counted(df, group_col, material, text_col, "SAMPLE1", "SAMPLE2" if with_max else None).orderBy(*descending("CNT"), *ascending(group_col))
    return out if n is None else out.limit(n)


def group_profile(
    products: DataFrame,
    texts: DataFrame,
    lang: str | None = D.TEXT_LANGUAGE,
    groups: Sequence[str] | None = None,
    prefix: str | None = None,
    with_max: bool = True,
    material: str = "MATNR",
    group_col: str = "MATKL",
    lang_col: str = "SPRAS",
    text_col: str = "MAKTX",
) -> DataFrame:
    """K7: per group, distinct products and the smallest/largest description,
    for a list of groups or groups starting with ``prefix``; ordered by group."""
    df = _described(products, texts, lang, material, group_col, lang_col, text_col)
    df = _group_filter(df, group_col, groups, None, None, prefix)
    return _counted(df, group_col, material, text_col, "SAMPLE1", "SAMPLE2" if with_max else None).orderBy(*ascending(group_col))


def keyword_samples(
    products: DataFrame,
    texts: DataFrame,
    rule: Rule | None,
    lang: str | None = D.TEXT_LANGUAGE,
    group: str | None = None,
    n: int = D.SAMPLE_ROWS,
    order: Sequence[str] = ("MAKTX",),
    material: str = "MATNR",
    group_col: str = "MATKL",
    lang_col: str = "SPRAS",
    text_col: str = "MAKTX",
) -> DataFrame:
    """K8: the first ``n`` matching descriptions with group and product.

    Result: ``MAKTX, MATKL, MATNR`` in ``order``, then by product so the cut
    at ``n`` repeats.
    """
    df = _described(products, texts, lang, material, group_col, lang_col, text_col)
    if group is not None:
        df = df.filter(F.col(group_col) == group)
    if rule is not None:
        df = df.filter(rule.column(text_col))
    sort = list(order) + ([material] if material not in order else [])
    return df.select(text_col, group_col, material).orderBy(*ascending(*sort)).limit(n)


def keyword_split(
    products: DataFrame,
    texts: DataFrame,
    rule: Rule,
    lang: str | None = D.TEXT_LANGUAGE,
    group: str | None = None,
    labels: tuple[str, str] = ("Match", "Other"),
    with_sample: bool = True,
    material: str = "MATNR",
    group_col: str = "MATKL",
    lang_col: str = "SPRAS",
    text_col: str = "MAKTX",
) -> DataFrame:
    """K9: distinct products of one group split by a rule into two labels.

    A NULL description goes to the second label (CASE ... ELSE). Result:
    ``TYPE, CNT`` and, with ``with_sample``, ``SAMPLE`` (smallest text).
    """
    df = _described(products, texts, lang, material, group_col, lang_col, text_col)
    if group is not None:
        df = df.filter(F.col(group_col) == group)
    label = F.when(rule.column(text_col), F.lit(labels[0])).otherwise(F.lit(labels[1]))
    return _counted(df.withColumn("TYPE", label), "TYPE", material, text_col, "SAMPLE" if with_sample else None)


# ---------------------------------------------------------------------------
# Many rules in one pass over the texts
# ---------------------------------------------------------------------------
#: Terms in one word of a bitmap.
WORD_BITS = 62


@dataclass(frozen=True)
class Search:
    """A rule over the text (None: every text) with its conditions on the
    product group: a list to take or leave, a part of its name (case folded),
    a prefix."""

    rule: Rule | None = None
    include: tuple[str, ...] | None = None
    exclude: tuple[str, ...] | None = None
    group_contains: str | None = None
    group_prefix: str | None = None

    def on_group(self, group: Column) -> Column | None:
        """The group's conditions as one Column; None if there are none."""
        tests = []
        if self.include is not None:
            tests.append(group.isin(list(self.include)))
        if self.exclude is not None:
            tests.append(~group.isin(list(self.exclude)))
        if self.group_contains is not None:
            tests.append(F.upper(group).contains(self.group_contains.upper()))
        if self.group_prefix is not None:
            tests.append(group.startswith(self.group_prefix))
        return reduce(lambda a, b: a & b, tests) if tests else None


def _as_search(s: Search | Rule | None) -> Search:
    return s if isinstance(s, Search) else Search(s)


def term_bits(text: Column, terms: Sequence[str]) -> Column:
    """Which of ``terms`` the upper-cased text contains, as an array of 64-bit
    words (``WORD_BITS`` terms each). The text is folded once. A NULL text
    contains none."""
    words = [terms[i : i + WORD_BITS] for i in range(0, len(terms), WORD_BITS)]

    def bits(folded: Column) -> Column:
        return F.array(*[
            reduce(
                lambda a, b: a.bitwiseOR(b),
                [F.when(folded.contains(t), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, t in enumerate(word)],
            )
            for word in words
        ])

    # bound once per row as the variable of a one-element transform
    return F.transform(F.array(F.upper(text)), bits)[0]


def _bit_test(rule: Rule, bits: Column, place: dict[str, int]) -> Column:
    """A rule over ``term_bits``: a set of terms is a mask of each word it touches."""

    def any_term(alternatives: tuple[str, ...]) -> Column:
        masks: dict[int, int] = {}
        for t in alternatives:
            word, bit = divmod(place[t], WORD_BITS)
            masks[word] = masks.get(word, 0) | 1 << bit
        return reduce(lambda a, b: a | b, [bits[w].bitwiseAND(F.lit(m).cast("long")) != 0 for w, m in masks.items()])

    clauses = [reduce(lambda a, b: a & b, [any_term(s) for s in c.sets]) for c in rule.clauses]
    return reduce(lambda a, b: a | b, clauses)


def keyword_matches(
    products: DataFrame,
    texts: DataFrame,
    searches: dict[str, Search | Rule | None],
    lang: str | None = D.TEXT_LANGUAGE,
    material: str = "MATNR",
    group_col: str = "MATKL",
    lang_col: str = "SPRAS",
    text_col: str = "MAKTX",
) -> DataFrame:
    """F10-F13 for many searches in one pass: a row ``SEARCH, MATKL, MATNR,
    MAKTX`` for each search that a product's description meets.

    Each text is read and folded once, and looked through once for each
    distinct term of all rules; a rule is then a few tests of bits. Texts that
    meet no rule go no further, the rest meet their product in one join.
    A NULL text meets only a search without a rule; conditions on the group
    are false for a NULL group.
    """
    found = {name: _as_search(s) for name, s in searches.items()}
    if not found:
        raise ValueError("at least one search is needed")
    terms = sorted({t for s in found.values() if s.rule for c in s.rule.clauses for alt in c.sets for t in alt})
    place = {t: i for i, t in enumerate(terms)}
    if lang is not None:
        texts = texts.filter(F.col(lang_col) == lang)
    texts = texts.select(material, text_col, (term_bits(F.col(text_col), terms) if terms else F.array(F.lit(0).cast("long"))).alias("_bits"))
    met = [
        F.when(F.coalesce(_bit_test(s.rule, F.col("_bits"), place), F.lit(False)) if s.rule else F.lit(True), F.lit(name))
        for name, s in found.items()
    ]
    # explode_outer: an explode would put a filter on the names below the scan's
    # projection, which folds every text a second time
    hits = texts.select(material, text_col, F.explode_outer(F.array_compact(F.array(*met))).alias("SEARCH")).filter(F.col("SEARCH").isNotNull())
    out = products.select(material, group_col).join(hits, on=material, how="inner")
    for name, s in found.items():
        test = s.on_group(F.col(group_col))
        if test is not None:
            out = out.filter((F.col("SEARCH") != name) | F.coalesce(test, F.lit(False)))
    return out.select("SEARCH", group_col, material, text_col)


def keyword_rules(
    products: DataFrame,
    texts: DataFrame,
    searches: dict[str, Search | Rule | None],
    lang: str | None = D.TEXT_LANGUAGE,
    material: str = "MATNR",
    group_col: str = "MATKL",
    lang_col: str = "SPRAS",
    text_col: str = "MAKTX",
) -> DataFrame:
    """K6 for many searches in one pass: ``SEARCH, MATKL, CNT`` (distinct
    products), ``SAMPLE1`` and ``SAMPLE2`` (smallest and largest matching
    text); by search, most products first, then group."""
    hits = keyword_matches(products, texts, searches, lang, material, group_col, lang_col, text_col)
    keyed = hits.select(F.struct("SEARCH", group_col).alias("_key"), material, text_col)
    out = _counted(keyed, "_key", material, text_col, "SAMPLE1", "SAMPLE2")
    return out.select("_key.SEARCH", f"_key.{group_col}", "CNT", "SAMPLE1", "SAMPLE2").orderBy(
        *ascending("SEARCH"), *descending("CNT"), *ascending(group_col)
    )


def keyword_rule_samples(
    products: DataFrame,
    texts: DataFrame,
    searches: dict[str, Search | Rule | None],
    lang: str | None = D.TEXT_LANGUAGE,
    n: int = D.SAMPLE_ROWS,
    order: Sequence[str] = ("MAKTX",),
    material: str = "MATNR",
    group_col: str = "MATKL",
    lang_col: str = "SPRAS",
    text_col: str = "MAKTX",
    shares: int = 64,
) -> DataFrame:
    """K8 for many searches in one pass: the first ``n`` descriptions of each
    search in ``order``, then by the other columns: ``SEARCH, POS, MAKTX,
    MATKL, MATNR``.

    The first ``n`` are taken in each of ``shares`` parts of a search (dealt by
    a hash of the product), then among these, so no task ranks all rows of a
    search that many texts meet.
    """
    hits = keyword_matches(products, texts, searches, lang, material, group_col, lang_col, text_col)
    rest = [c for c in (text_col, group_col, material) if c not in order]
    by = ascending(*order, *rest)
    dealt = hits.withColumn("_share", F.pmod(F.xxhash64(material), F.lit(shares)))
    first = dealt.withColumn("_pos", F.row_number().over(Window.partitionBy("SEARCH", "_share").orderBy(*by))).filter(F.col("_pos") <= n)
    ranked = first.withColumn("POS", F.row_number().over(Window.partitionBy("SEARCH").orderBy(*by))).filter(F.col("POS") <= n)
    return ranked.select("SEARCH", "POS", text_col, group_col, material)
