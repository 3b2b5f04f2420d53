"""Exact dedup by progressive refinement (DataFrame functions only).

Texts are compared after deleting the six ASCII white-space characters. Level 1 groups the
rows by the byte length of that normalised text, level 2 those whose length repeats by the hash
of its first characters, level 3 those whose (length, prefix) repeats by the SHA-256 of all of
it. Levels 1 and 2 work on a narrow table; the full text is hashed only for rows that get to
level 3, unless the caller wants the digest of every row: then level 3 takes that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE, maybe_broadcast, stored, text_or_empty


def normalised(text_col: str = "text") -> Column:
    return F.translate(text_or_empty(text_col), WHITE, "")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 48,
    carry: Sequence[Column] = (),
    digest: str | None = None,
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size`` (rows), ``kept``, then ``carry``,
    and with ``digest`` a column of that name, the lowercase hex SHA-256 of the normalised text.

    ``carry`` are columns computed from ``docs`` in the first scan and passed through. Of
    equal texts the row with the most code points in its original text stays, then the
    smallest id.

    Null text counts as empty; all empty or white texts form one group. A null id sorts
    after every other id. Rows repeated with one id are rows of one group: each is counted
    in ``group_size`` and each is ``kept`` if that id and text is the one that stays. Other
    columns of ``docs`` are ignored, whatever their names. An empty table gives no rows.

    Scale: one scan writes a narrow table (id, length, prefix hash, the digest if wanted) to the
    shared folder. Each level counts with map-side combine, so a group of any size costs one
    partial row per task, and passes on only the rows of groups of two or more; its groups are
    broadcast up to a counted bound. Prefixes are hashed in the first scan already: 48 characters
    cost less than to read the texts once more. Without ``digest`` a second scan hashes the
    texts of level 3.
    """
    norm = F.col("_norm")
    carried = [c.alias(f"_carry{i}") for i, c in enumerate(carry)]
    names = docs.select(*carry).columns if carry else []
    # a deterministic projection that is cheap to repeat: the scan reads two columns only
    keyed = docs.select(
        F.col(id_col).alias("_id"),
        normalised(text_col).alias("_norm"),
        F.length(text_or_empty(text_col)).cast("long").alias("_chars"),
        *carried,
    )
    keys = [F.octet_length(norm).cast("long").alias("_len"), F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("_pre")]
    sha = F.unhex(F.sha2(norm.cast("binary"), 256)).alias("_full")
    kept_columns = ["_id", "_chars", *(f"_carry{i}" for i in range(len(names)))]
    base = stored(keyed.select(*keys, *kept_columns, *([sha] if digest else [])), "dedup-base")

    lengths = repeated_lengths(base)
    survivors = repeated_prefixes(base, lengths)
    n_survivors = survivors.count()
    source = base if digest else keyed.select(*keys, *kept_columns, "_norm")
    source = source.join(maybe_broadcast(survivors, n_survivors), ["_len", "_pre"], "left_semi")
    full = source if digest else stored(source.select("_len", "_pre", sha, *kept_columns), "dedup-full")
    group = ["_len", "_pre", "_full"]
    best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("z"), F.col("_id").alias("id")))
    groups = stored(
        full.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_size"), best.alias("_best"))
        .select(*group, "_size", F.col("_best.id").alias("_keep"), (-F.col("_best.c")).alias("_keep_chars")),
        "dedup-groups",
    )
    shown = [F.lower(F.hex("_full")).alias("_digest")] if digest else []
    grouped = full.join(groups, group).select(
        *kept_columns, *shown, "_keep", "_size", (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_chars") == F.col("_keep_chars"))).alias("_stays")
    )
    alone = base.join(maybe_broadcast(survivors, n_survivors), ["_len", "_pre"], "left_anti").select(
        *kept_columns, *shown, F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"), F.lit(True).alias("_stays")
    )
    return grouped.unionByName(alone).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_stays").alias("kept"),
        *(F.col(f"_carry{i}").alias(n) for i, n in enumerate(names)),
        *([F.col("_digest").alias(digest)] if digest else []),
    )


def repeated_lengths(base: DataFrame) -> DataFrame:
    """Level 1: the lengths of two rows or more."""
    return stored(base.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_len"), "dedup-lengths")


def repeated_prefixes(base: DataFrame, lengths: DataFrame) -> DataFrame:
    """Level 2: of rows with such a length, the (length, prefix) groups of two rows or more."""
    rows = base.select("_len", "_pre").join(maybe_broadcast(lengths, lengths.count()), "_len", "left_semi")
    return stored(rows.groupBy("_len", "_pre").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_len", "_pre"), "dedup-survivors")
