"""Salted joins equal plain joins, read the facts once and spread a hot key."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from salesloom.operators.joins import salted_join


@pytest.fixture()
def fact(spark):
    return spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("H1"))
        .when(F.col("id") % 7 == 0, F.lit(None))
        .otherwise((F.col("id") % 400).cast("string")).alias("K"),
        (F.col("id") % 10).alias("V"),
    )


@pytest.fixture()
def dim(spark):
    return spark.createDataFrame(
        [("H1", "hot"), ("H1", "hot too")] + [(str(k), f"d{k}") for k in range(0, 400, 2)] + [(None, "null")], "K string, D string"
    )


@pytest.mark.parametrize("how", ["inner", "left_semi"])
@pytest.mark.parametrize("salts", [None, 1, 5])
def test_salted_join_equals_plain_join(fact, dim, how, salts):
    plain = fact.join(dim, on=["K"], how=how)
    salted = salted_join(fact, dim, ["K"], how, salts)
    assert salted.columns == plain.columns
    assert sorted(map(tuple, salted.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_other_arguments_are_refused(fact, dim):
    with pytest.raises(ValueError):
        salted_join(fact, dim, ["K"], "left", 5)
    with pytest.raises(ValueError):
        salted_join(fact, dim, ["K"], "inner", 0)


def test_a_hot_key_of_equal_rows_is_spread(spark, dim):
    """Copies of one row would share a salt taken from their values."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        copies = spark.range(4000).select(F.lit("H1").alias("K"), F.lit(1).alias("V"))
        rows = salted_join(copies, dim.filter("D = 'hot'"), ["K"], "inner", 16)
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 4000 / 3
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
