"""Joins that keep hot keys out of any single task without relying on AQE, and
a filter that keeps rows without a partner out of a shuffle.

By default the jobs leave skew to AQE's skew-join splitting. The explicit
alternative is salting: each fact row is dealt to one of ``salts`` parts and
the dimension is repeated for every part, so the rows of one key spread over
``salts`` tasks. The facts are read once, nothing is counted or broadcast by a
hint, and the price is ``salts`` copies of the dimension's rows in its shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = "_salt"


def salted_join(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salts: int | None = None,
) -> DataFrame:
    """``fact.join(dim, on, how)`` with each key's fact rows spread over
    ``salts`` tasks (None or 1: the plain join). ``how`` is ``"inner"`` or
    ``"left_semi"``. Equal fact rows are dealt out too: the salt is the row's
    running number, not a hash of it."""
    on = list(on)
    if how not in ("inner", "left_semi"):
        raise ValueError("how must be 'inner' or 'left_semi'")
    if salts is not None and salts < 1:
        raise ValueError("salts must be at least 1")
    if salts in (None, 1):
        return fact.join(dim, on=on, how=how)
    dealt = fact.withColumn(SALT, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = dim.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, on=[*on, SALT], how=how).drop(SALT)


def key_filter(
    fact: DataFrame,
    keys: DataFrame,
    on: Sequence[str],
    bits: int = 22,
) -> DataFrame:
    """The rows of ``fact`` whose key may be in ``keys``: all that have a
    partner there, and few others. A join with ``keys`` must follow.

    The hashed keys set bits of a map of ``2 ** bits`` places, 64 to a word,
    which is joined as a broadcast: it has at most ``2 ** bits / 64`` rows of
    two numbers whatever the tables hold (``bits=22``: 65,536 rows, 1 MB; at
    most 30). The map is combined before its shuffle, and ``fact`` is filtered
    where it is scanned, so rows without a partner are in no shuffle. With k
    distinct keys about k / 2 ** bits of the other rows pass; a full map
    filters nothing and costs one broadcast join. A NULL key never passes, as
    in a join.
    """
    if not 6 <= bits <= 30:
        raise ValueError("bits must be 6 to 30")
    on = list(on)
    here = F.shiftrightunsigned(F.xxhash64(*on), 64 - bits)
    held = F.lit(True)
    for c in on:
        held = held & F.col(c).isNotNull()
    words = (
        keys.filter(held)
        .select(here.alias("_at"))
        .groupBy(F.shiftright("_at", 6).alias("_word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_at").bitwiseAND(63).cast("int"))).alias("_bits"))
    )
    words = F.broadcast(words.withColumnRenamed("_word", "_map_word"))
    placed = fact.filter(held).select("*", here.alias("_at"), F.shiftrightunsigned(here, 6).alias("_word"))
    # a semi join: Catalyst does not push a later semi join (a version pick) below it
    passed = F.call_function("getbit", F.col("_bits"), F.col("_at").bitwiseAND(63).cast("int")) == 1
    return placed.join(words, (F.col("_word") == F.col("_map_word")) & passed, "left_semi").select(*fact.columns)
