"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly
(DataFrame functions only).

A short item inside a long document has a tiny Jaccard similarity with the whole document, so
MinHash is applied to windows. Items are put into size classes: class Q holds the items of
more than Q/2 and at most Q shingles. For each class every document is cut into windows of 2Q
shingles, Q apart, so any run of Q shingles lies in one window. In a class all sizes are
bounded, so the containment threshold gives a least Jaccard similarity of item and window,
and that gives the number k of smallest hashes (the MinHash sketch) at which two such sets
share a sketch value with the wanted probability. Document and item pairs that share one are
candidates; each is verified by counting the item's shingles in the whole document. An item of
fewer than five words is one shingle of all its words, looked for at every place of a document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE, maybe_broadcast, stored, text_or_empty
from .license_scan import LOWER, UPPER

#: Words of a shingle, least share of an item's shingles, chance to miss a pair at that share.
SHINGLE, THRESHOLD, MISS = 5, 0.8, 1e-4
#: Counted bytes of all items' shingles up to which they are broadcast.
BROADCAST_BYTES = 8 << 20


def words_of(col: str) -> Column:
    """Words between white space, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(text_or_empty(col), UPPER, LOWER), f"[{WHITE}]+"), "")


def _starts(words: Column, n: Column | int) -> Column:
    """Starts of the shingles of n words (none in a text of fewer words)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when((n > 0) & (F.size(words) >= n), F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(words: Column, n: int = SHINGLE) -> Column:
    return F.transform(_starts(words, n), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))


def shingle_texts(words: Column, n: Column | int = SHINGLE) -> Column:
    return F.array_distinct(F.transform(_starts(words, n), lambda i: F.array_join(F.slice(words, i + 1, n), " ")))


def sketch_size(q: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Smallest hashes to keep in class ``q``: at the least Jaccard similarity s of an item of
    at least q/2 shingles, a share ``threshold`` of them in a window of 2q, (1 - s)^k is at
    most ``miss``. A window of no more than k shingles is kept whole."""
    least = max(1, q // 2)
    s = threshold * least / (2 * q + (1 - threshold) * least)
    return min(2 * q, math.ceil(math.log(miss) / math.log1p(-s)))


def _window_sketch(hashes: Column, q: int, k: int) -> Column:
    """Distinct sketch values of all windows of class ``q``."""

    def sketch(start: Column) -> Column:
        return F.slice(F.sort_array(F.array_distinct(F.slice(hashes, start, 2 * q))), 1, k)

    # the last window starts within the last 2q shingles; a shorter text is one window
    last = F.greatest(F.lit(1), F.size(hashes) - q)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), last, F.lit(q)), sketch)))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Pairs (id, item id, ``item_shingles``, ``shared``, ``containment``) where the document
    has at least ``threshold`` of the item's distinct five-word shingles. An item of one to four
    words is one shingle of all its words.

    Null texts count as empty. Items without words are in no pair. Rows repeated with one id, of either table, give one pair with the
    largest containment; a null id is an id like any other. Other columns are not read. An
    empty table of either kind gives no rows.

    Scale: documents are read twice (sketch, then verification of candidates). Sketches meet
    the items' in a broadcast join if the items' sketch rows are counted to be within
    ``BROADCAST_ROWS``, else in a shuffle join; likewise candidates meet their texts, row by row:
    rows that share an id are told apart by a hash of their text. Items' shingles are broadcast
    up to ``BROADCAST_BYTES`` counted bytes.
    """
    # item side: small against the documents, but of no assumed size
    words = F.col("_words")
    own = F.least(F.lit(SHINGLE), F.size(words))
    short = [F.when(own == n, F.array(F.xxhash64(*(F.get(words, F.lit(k)) for k in range(n))))) for n in range(1, SHINGLE)]
    listed = items.select(F.col(item_id_col).alias("_item"), words_of(item_text_col).alias("_words")).filter(F.size("_words") > 0)
    listed = listed.select("_item", shingle_texts(words, own).alias("_shingles"), F.coalesce(*short, F.array_distinct(shingle_hashes(words))).alias("_hashes"), own.alias("_own"))
    # the class of a short item is its number of words, below zero
    size_class = F.pow(F.lit(2), F.ceil(F.log2(F.size("_hashes").cast("double")))).cast("int")
    listed = stored(listed.distinct().withColumn("_class", F.when(F.col("_own") < SHINGLE, -F.col("_own")).otherwise(size_class)), "items")
    classes = sorted(r[0] for r in listed.select("_class").distinct().collect())  # powers of two: few
    sizes = {q: sketch_size(q, threshold) if q > 0 else 1 for q in classes}
    spans = sorted({SHINGLE if q > 0 else -q for q in classes})
    kept = F.coalesce(*(F.when(F.col("_class") == q, k) for q, k in sizes.items()), F.lit(0))
    sketches = listed.select("_item", "_class", F.explode(F.slice(F.sort_array("_hashes"), 1, kept)).alias("_value"))
    n_sketch = sketches.count()

    # explode_outer: explode would add a filter that works out the arrays a second time
    # a row is known by its id and text: many rows may share an id
    row = [F.col(id_col).alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("_text_hash")]
    hashed = docs.select(*row, words_of(text_col).alias("_words"))
    hashed = hashed.select("_id", "_text_hash", *(shingle_hashes(words, n).alias(f"_hashes{n}") for n in spans))
    by_class = [
        F.struct(F.lit(q).alias("_class"), (_window_sketch(F.col(f"_hashes{SHINGLE}"), q, k) if q > 0 else F.array_distinct(f"_hashes{-q}")).alias("_values"))
        for q, k in sizes.items()
    ]
    none = F.array().cast("array<struct<_class:int,_values:array<bigint>>>")
    values = (
        hashed.select("_id", "_text_hash", F.explode_outer(F.array(*by_class) if by_class else none).alias("_c"))
        .select("_id", "_text_hash", F.col("_c._class").alias("_class"), F.explode_outer("_c._values").alias("_value"))
    )
    found = values.join(maybe_broadcast(sketches, n_sketch), ["_class", "_value"])
    pairs = stored(found.select("_id", "_text_hash", "_item").distinct(), "candidates")
    return _verified(docs.select(*row, F.col(text_col).alias("_text")), pairs, pairs.count(), listed, spans, id_col, item_id_col, threshold)


def _verified(docs, pairs, n_pairs, listed, spans, id_col, item_id_col, threshold) -> DataFrame:
    same = F.col("_id").eqNullSafe(F.col("_pid")) & (F.col("_text_hash") == F.col("_phash"))
    pairs = pairs.withColumnsRenamed({"_id": "_pid", "_text_hash": "_phash"})
    rows = pairs.select("_pid", "_phash").distinct()
    texts = docs.join(maybe_broadcast(rows, n_pairs), same, "left_semi").dropDuplicates(["_id", "_text_hash"])
    texts = texts.select("_id", "_text_hash", words_of("_text").alias("_words"))
    texts = texts.select("_id", "_text_hash", F.concat(*(shingle_texts(F.col("_words"), n) for n in spans)).alias("_have") if spans else F.array().cast("array<string>").alias("_have"))
    wanted = listed.select(F.col("_item").alias("_witem"), "_shingles")
    size = wanted.agg(F.sum(F.octet_length(F.array_join("_shingles", "")))).first()[0] or 0
    named = pairs.join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, F.col("_item").eqNullSafe(F.col("_witem")))
    shared = F.size(F.array_intersect("_shingles", "_have"))
    return (
        texts.join(named, same)
        .select("_id", "_item", F.size("_shingles").alias("_size"), shared.alias("_shared"))
        .filter(F.col("_shared") >= F.lit(threshold) * F.col("_size"))
        .groupBy("_id", "_item")
        .agg(F.max(F.struct((F.col("_shared") / F.col("_size")).alias("c"), F.col("_size").alias("n"), F.col("_shared").alias("s"))).alias("_best"))
        .select(
            F.col("_id").alias(id_col),
            F.col("_item").alias(item_id_col),
            F.col("_best.n").cast("long").alias("item_shingles"),
            F.col("_best.s").cast("long").alias("shared"),
            F.col("_best.c").alias("containment"),
        )
    )
