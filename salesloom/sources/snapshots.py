"""Stored tables: newest load of a partitioned snapshot, bucketed catalog
tables under a default schema, and derived tables that are built once.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import new_folder, shared_folder
from .tables import use_schema

#: Folder name of a NULL partition value (fixed by the table layout).
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def newest_load(spark: SparkSession, path: str, version: str = "FILE_DATE") -> dt.date | None:
    """A9/F15 from metadata: the newest load date of a snapshot table stored
    by ``tables.write_versioned``, None if it has no rows.

    The dates are the names of the table's folders, from the file listing that
    any read of the table makes; no column is read. A load may have left files
    without rows, so the newest date is taken whose files hold one (their
    footers tell, newest first). A NULL load date never counts, as in MAX.
    """
    table = spark.read.parquet(path)
    mark = f"/{version}="
    found = {unquote(f.split(mark, 1)[1].split("/", 1)[0]) for f in table.inputFiles() if mark in f}
    if not found and table.inputFiles():
        raise ValueError(f"{path} is not partitioned by {version}")
    for day in sorted((dt.date.fromisoformat(v) for v in found if v != NULL_PARTITION), reverse=True):
        if not table.filter(F.col(version) == F.lit(day)).select(version).limit(1).isEmpty():
            return day
    return None


def create_schema(spark: SparkSession, name: str | None = None) -> str:
    """A new database whose tables lie in the shared folder; its name."""
    name = name or f"salesloom_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE `{name}` LOCATION '{shared_folder(spark)}/{name}'")
    return name


@contextmanager
def default_schema(spark: SparkSession, schema: str) -> Iterator[None]:
    """S3 for a block: unqualified names mean tables of ``schema``; frames made
    inside keep their meaning, and the old default is back afterwards."""
    old = spark.catalog.currentDatabase()
    use_schema(spark, schema)
    try:
        yield
    finally:
        use_schema(spark, old)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, schema: str | None = None) -> None:
    """Store ``df`` as a catalog table bucketed and sorted by ``keys``.

    Tables bucketed alike on a common business key meet in joins and groupings
    on it, and in those on more columns of a grouping, without an exchange
    (``latest_version(..., colocated=True)``, the header join). Rows are
    shuffled by the keys once here, into one file per bucket. Each key lies in
    one bucket: choose ``buckets`` for the largest table's size, and plain
    storage for a key that a large share of the rows has.
    """
    name = f"`{schema}`.`{table}`" if schema else f"`{table}`"
    (
        df.repartition(buckets, *keys)
        .write.mode("overwrite")
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .saveAsTable(name)
    )


_BUILT: dict[tuple, str] = {}


def _state(df: DataFrame) -> tuple:
    """Names, sizes and times of the files behind a read table; one row a file."""
    meta = F.col("_metadata")
    files = df.select(meta["file_path"], meta["file_size"], meta["file_modification_time"].cast("string")).distinct().collect()
    return tuple(sorted(tuple(f) for f in files))


def derived(name: str, inputs: Sequence[DataFrame], build: Callable[[str], None], folder: Callable[[SparkSession], str] | None = None) -> str:
    """The folder (or schema) of what ``build`` makes of ``inputs`` (plain
    reads of files): built on first use in an application, and again when the
    inputs' files have changed. ``folder`` makes the new place."""
    spark = inputs[0].sparkSession
    key = (spark.sparkContext.applicationId, shared_folder(spark), name, *(_state(df) for df in inputs))
    if key not in _BUILT:
        place = folder(spark) if folder else new_folder(spark, name)
        build(place)
        _BUILT[key] = place
    return _BUILT[key]
