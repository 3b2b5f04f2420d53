"""The corpus pipeline: five stages over the documents, each calling an operator of
``salesloom.llm``. Each stage works on what its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from salesloom.llm import bpe_codec, rule_quality
from salesloom.llm.common import fold_of, maybe_broadcast, stored, table
from salesloom.llm.decontaminate import contained_items
from salesloom.llm.exact_dedup import exact_dedup
from salesloom.llm.near_dup import near_duplicates

#: The documents' own columns, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """``docs`` whose ``key`` is not in ``gone`` (one column); keys are broadcast up to a
    counted bound."""
    gone = stored(gone.toDF("_gone").distinct(), "gone")
    rows = docs.withColumn("_key", key)
    return rows.join(maybe_broadcast(gone, gone.count()), F.col("_key").eqNullSafe(F.col("_gone")), "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject (score of 0.5 or more)."""
    model = rule_quality.fit_from_labels(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 3) != 1)
    scored = rule_quality.with_statistics(docs, "text", COLUMNS)
    return scored.filter(model.score(F.col(rule_quality.STATS)) >= 0.5).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    text = _text_hash()
    found = exact_dedup(docs, carry=[text.alias("text_hash")])
    gone = stored(found.filter("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct(), "gone")
    rows = docs.withColumn("_own", text).join(
        maybe_broadcast(gone, gone.count()), F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.col("_own") == F.col("_hash")), "left_anti"
    )
    # a row repeated with its id is kept as often as it stands there: leave one
    stays = found.filter("kept").agg(F.count(F.lit(1)), F.count_distinct(F.coalesce("doc_id", F.lit(-1)), "text_hash")).first()
    return (rows if stays[0] == stays[1] else rows.dropDuplicates(["doc_id", "_own"])).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest id; of rows with that id the
    one with the smallest text hash. Rows without an id stay."""
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return _without(docs, F.col("doc_id"), near_duplicates(docs).filter("NOT kept").select("doc_id"))
    # an id has several texts: each row is a document of its own, under a key of id and text
    row = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", _text_hash()))
    rows = docs.select(row.alias("_row"), "doc_id", "text")
    found = near_duplicates(rows, id_col="_row").filter("_row IS NOT NULL").select("_row", "class_id").distinct()
    named = stored(found.join(rows.select("_row", "doc_id").distinct(), "_row"), "near-rows")
    first = named.groupBy("class_id").agg(F.min(F.struct("doc_id", "_row")).alias("_first")).select("_first._row")
    return _without(docs, row, named.join(first, "_row", "left_anti").select("_row"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no item of the benchmark, each decided by its own text."""
    row = F.struct("doc_id", _text_hash().alias("text_hash"))
    found = contained_items(docs.withColumn("_row", row), table(spark, sf_dir, "benchmark"), id_col="_row")
    return _without(docs, row, found.select("_row"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text."""
    return bpe_codec.round_trip(docs, TOKENIZER)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminated", decontaminated), ("encoded", encoded)]

#: SQL can express neither the classifier, the sampling nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
