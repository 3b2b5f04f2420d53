"""License scan: phrases, and an exact set-similarity join of text blocks with templates
(DataFrame functions only).

A block meets a template if it holds at least ``threshold`` of the template's distinct words.
Blocks are lines, or, with ``windows``, runs of words that do not depend on line breaks: for a
template of n words the runs of 2n words (rounded up to even n), n / 2 apart, so that each run of
up to 1.5n words lies in one of them, and nothing longer than 2n words is a block. All words of templates are put in one global order, rarest in the corpus
first. A block is cut to those words, in that order, and a pair is looked at only if

* prefix: the block has one of the template's first ``size - needed + 1`` words; this is an
  equality join of the places of such words with an index of the templates' prefixes,
* length: the cut block has at least as many words as the template needs, and
* position: around the joined word both sides have enough words to get there;

what is left is verified by counting the common words. No filter loses a pair. With ``windows`` a
block must also have the template's telling phrases: of neighbours such as the notices of GPL,
LGPL and AGPL, which share nearly all words, only the right one is met.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from .common import maybe_broadcast, stored, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices that projects put into files: the label they stand for, the notice, and the phrases
#: that tell it from its neighbours, without which a block does not meet it.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache", "2 0"]),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache org licenses LICENSE-2.0", ["apache org"]),
    ("mit", "Released under the MIT License", ["mit"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["free of charge", "obtaining a copy"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    ("gpl", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["gnu general public license"]),
    ("lgpl", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["lesser general public license"]),
    ("agpl", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["source and binary forms"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license", "2 0"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["commons attribution 4 0"]),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["attribution sharealike 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["by nc 4 0"]),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered"]),
]
TEMPLATES = [(label, notice) for label, notice, _ in NOTICES]
TELLING = {notice: telling for _, notice, telling in NOTICES}


def words_of(text: Column) -> Column:
    """The words of a text whose A-Z are lower-cased, in order."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP), "")


def notice_words(text: str) -> list[str]:
    """Words of a template (ASCII letters and digits), in order."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def template_words(text: str) -> list[str]:
    """Distinct words of a template."""
    return list(dict.fromkeys(notice_words(text)))


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]  # in the global order
    needed: int
    length: int  # words of the notice, repeated ones too

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.words[: len(self.words) - self.needed + 1]


def global_order(docs: DataFrame, templates: list[tuple[str, str]], text_col: str) -> list[str]:
    """The words of all templates, rarest first: by the number of documents that have them, of
    all documents, then by spelling. At most as many rows as templates have words reach the
    driver."""
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    # explode_outer: explode would add a filter that splits every text a second time
    found = docs.select(F.array_intersect(_array(vocabulary), words_of(text_or_empty(text_col))).alias("_own"))
    found = found.select(F.explode_outer("_own").alias("w"))
    counts = {r["w"]: r["count"] for r in found.groupBy("w").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def ordered_templates(templates: list[tuple[str, str]], order: list[str], threshold: float) -> list[Template]:
    rank = {w: i for i, w in enumerate(order)}
    out = []
    for label, text in templates:
        words = tuple(sorted(template_words(text), key=rank.__getitem__))
        out.append(Template(label, words, math.ceil(threshold * len(words) - 1e-9), len(notice_words(text))))
    return out


def _array(words) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")


def _meets(block: Column, t: Template) -> Column:
    """Whether a cut block (template words, in the global order) meets the template."""
    words = _array(t.words)
    common = F.array_intersect(words, block)
    first = F.element_at(common, 1)
    left = F.least(F.lit(len(t.words)) - F.array_position(words, first), F.size(block) - F.array_position(block, first))
    return (
        (F.size(block) >= t.needed)
        & F.arrays_overlap(_array(t.prefix), block)
        & (left + 1 >= t.needed)
        & (F.size(common) >= t.needed)
    )


def _best(blocks: Column, t: Template) -> Column:
    """Most words of the template in a block that meets it, else null."""
    return F.array_max(F.transform(F.filter(blocks, _meets_one(t)), _common_size(t)))


def _hits(best: list[Column], templates: list[Template]) -> Column:
    """(label, containment) of each template met by some block, with the largest containment."""
    found = []
    for b, t in zip(best, templates):
        found.append(F.when(b.isNotNull(), F.struct(F.lit(t.label).alias("label"), (b / F.lit(float(len(t.words)))).alias("share"))))
    return F.array_compact(F.array(*found))


def _meets_one(t: Template):
    return lambda block: _meets(block, t)


def _common_size(t: Template):
    return lambda block: F.size(F.array_intersect(_array(t.words), block)).cast("double")


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] | None = None,
    templates: list[tuple[str, str]] | None = None,
    threshold: float = 0.9,
    block_pattern: str = r"\n",
    windows: bool = False,
) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_base`` (places of phrases), ``first_word``
    and ``last_word`` (smallest and largest start of a place, else null), ``base_labels``,
    ``labels`` (phrases and templates) and ``score``: 1 if a phrase is there, else the largest
    containment of a template that is met, else 0. Blocks are the parts between
    ``block_pattern``, or with ``windows`` the runs of words sized from each template.

    Null text counts as empty: no words, empty labels. Repeated rows and null ids are passed
    through; other columns are not read. Labels are distinct and sorted, so ties need no rule.
    An empty table gives no rows.

    ``templates`` are (label, notice) or (label, notice, telling phrases); own ones without
    telling phrases are met by their words alone.

    Scale: texts are read once to count the templates' words over all rows, and with ``windows``
    once more. A row keeps its base columns and, for each place
    of a prefix word, the words around it (a bound set by the longest template); these are stored,
    and all joins are over them. Templates are tables, broadcast up to a counted bound. Without
    ``windows`` the templates are unrolled into one scan, and the plan grows with their number.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = NOTICES if templates is None else templates
    telling = [t[2] if len(t) > 2 else [] for t in templates]
    templates = [t[:2] for t in templates]
    order = global_order(docs, templates, text_col)
    ordered = ordered_templates(templates, order, threshold)
    if windows:
        return _join(docs, id_col, text_col, phrases, ordered, telling, order)
    return _scan(docs, id_col, text_col, phrases, ordered, order, block_pattern)


def _places(words: Column, phrases: dict[str, str]) -> tuple[Column, list[Column]]:
    """Starts of the phrases' places, and for each phrase its label if it has one of them."""
    # only where some phrase's first word occurs
    parts = {p: p.split(" ") for p in phrases}

    def starts_here(i: Column) -> Column:
        return reduce(or_, (_phrase_at(words, ws)(i) for ws in parts.values()), F.lit(False))

    firsts = _array(sorted({ws[0] for ws in parts.values()}))
    none = F.array().cast("array<int>")
    places = F.when(
        F.arrays_overlap(words, firsts), F.filter(F.sequence(F.lit(0), F.size(words) - 1), starts_here)
    ).otherwise(none)
    base = [F.when(F.exists("_places", _phrase_at(words, ws)), F.lit(phrases[p])) for p, ws in parts.items()]
    return places, base


def _base_columns(base: list[Column]) -> list[Column]:
    """``n_base``, ``first_word``, ``last_word`` and the distinct labels, of ``_places``."""
    found = F.size("_places") > 0
    return [
        F.size("_places").cast("long").alias("n_base"),
        F.get("_places", F.lit(0)).cast("long").alias("first_word"),
        F.when(found, F.element_at("_places", -1)).cast("long").alias("last_word"),
        F.when(found, F.array_sort(F.array_distinct(F.array_compact(F.array(*base))))).otherwise(F.array().cast("array<string>")).alias("_base"),
    ]


def _result(rows: DataFrame, id_col: str) -> DataFrame:
    """The result's columns, of base columns and ``_hits`` (label, share)."""
    return rows.select(
        id_col, "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.col("_hits.label"))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("_hits.share")), F.lit(0.0))).alias("score"),
    )


def _join(docs, id_col, text_col, phrases, ordered, telling, order) -> DataFrame:
    """Windows of documents joined with templates by their prefix words."""
    spark, words = docs.sparkSession, F.col("_words")
    steps = [max(1, -(-t.length // 2)) for t in ordered]
    reach = 4 * max(steps, default=1)
    least = min((t.needed for t in ordered), default=1)
    prefix = sorted({w for t in ordered for w in t.prefix})
    index = spark.createDataFrame([(w, k, step) for k, (t, step) in enumerate(zip(ordered, steps)) for w in t.prefix], "word string, template int, step int")
    table = spark.createDataFrame([(k, t.label, list(t.words), t.needed, [f" {p} " for p in more]) for k, (t, more) in enumerate(zip(ordered, telling))], "template int, label string, notice array<string>, needed int, telling array<string>")

    places, base = _places(words, phrases)
    # the words around each place of a prefix word, if there are enough template words among them
    near = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(*prefix)),
        lambda i: F.struct(i.alias("at"), F.get(words, i).alias("word"), F.greatest(F.lit(0), i - reach).alias("begin"), F.slice(words, F.greatest(F.lit(0), i - reach) + 1, 2 * reach).alias("around")),
    )
    near = F.when(F.arrays_overlap(words, _array(prefix)), F.filter(near, lambda x: F.size(F.array_intersect(_array(order), x["around"])) >= least))
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("_text")).withColumn("_words", words_of(F.col("_text")))
    rows = rows.select(id_col, F.size(words).cast("long").alias("n_words"), "_words", places.alias("_places"), (near if prefix else F.lit(None).cast("array<struct<at:int,word:string,begin:int,around:array<string>>>")).alias("_near"))
    rows = stored(rows.select(id_col, "n_words", *_base_columns(base), "_near", F.monotonically_increasing_id().alias("_row")), "license-places")

    last = F.col("at") - F.col("at") % F.col("step")
    pairs = rows.filter(F.size("_near") > 0).select("_row", F.explode_outer("_near").alias("n")).select("_row", "n.*")
    pairs = pairs.join(maybe_broadcast(index, len(prefix) * len(ordered)), "word")
    # a place is in four windows: the last one to start at or before it, and the three before that
    pairs = pairs.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), last - 3 * F.col("step")), last, F.col("step"))))
    pairs = pairs.select("_row", "word", "template", F.slice("around", F.col("start") - F.col("begin") + 1, 4 * F.col("step")).alias("window"))
    pairs = pairs.withColumn("block", F.array_intersect(_array(order), F.col("window"))).join(maybe_broadcast(table, len(ordered)), "template")
    here, there = F.array_position("block", F.col("word")), F.array_position("notice", F.col("word"))
    before, behind = F.least(here, there) - 1, F.least(F.size("block") - here, F.size("notice") - there)
    pairs = pairs.filter((F.size("block") >= F.col("needed")) & (before + 1 + behind >= F.col("needed")))
    shared = F.size(F.array_intersect("notice", "block"))
    spelt = F.concat(F.lit(" "), F.array_join("window", " "), F.lit(" "))
    met = pairs.withColumn("shared", shared).filter((F.col("shared") >= F.col("needed")) & F.forall("telling", lambda p: F.contains(spelt, p)))
    hits = met.groupBy("_row", "label").agg(F.max(F.col("shared") / F.size("notice")).alias("share"))
    hits = hits.groupBy("_row").agg(F.collect_list(F.struct("label", "share")).alias("_hits"))
    none = F.array().cast("array<struct<label:string,share:double>>")
    joined = rows.drop("_near").join(hits, "_row", "left").withColumn("_hits", F.coalesce("_hits", none))
    return _result(joined, id_col)


def _scan(docs, id_col, text_col, phrases, ordered, order, block_pattern) -> DataFrame:
    """Lines against all templates, each document in its own row."""
    text, words = F.col("_text"), F.col("_words")
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).withColumn("_words", words_of(text))
    places, base = _places(words, phrases)

    # templates: blocks of rows that have a word of some prefix
    in_prefix = sorted({w for t in ordered for w in t.prefix})
    prefixes = _array(in_prefix)
    cut = lambda ws: F.array_intersect(_array(order), ws)
    least = min((t.needed for t in ordered), default=1)
    blocks = F.filter(F.transform(F.split(text, block_pattern), lambda line: cut(words_of(line))), lambda b: F.size(b) >= least)
    best = [_best(F.col("_blocks"), t) for t in ordered]
    none_found = F.array().cast("array<array<string>>")
    blocks = F.when(F.arrays_overlap(words, prefixes), blocks).otherwise(none_found)

    rows = rows.select("_id", F.size(words).cast("long").alias("n_words"), "_words", places.alias("_places"), blocks.alias("_blocks"))
    # an array of its own: what is worked out for a template is used twice
    rows = rows.withColumn("_best", F.when(F.size("_blocks") > 0, F.array(*best).cast("array<double>")))
    hits = F.when(F.size("_blocks") > 0, _hits([F.get("_best", F.lit(i)) for i in range(len(ordered))], ordered)).otherwise(F.array().cast("array<struct<label:string,share:double>>"))
    return _result(rows.select(F.col("_id").alias(id_col), "n_words", *_base_columns(base), hits.alias("_hits")), id_col)


def _phrase_at(words: Column, phrase: list[str]):
    return lambda i: reduce(and_, (F.get(words, i + k).eqNullSafe(F.lit(w)) for k, w in enumerate(phrase)))
