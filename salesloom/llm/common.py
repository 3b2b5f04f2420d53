"""Helpers shared by the operators: table access, stored intermediates, batch loops."""

from __future__ import annotations


import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The six characters of ``[\x20\x09-\x0D]``.
WHITE = " \t\n\x0b\x0c\r"

#: Largest row count of a table that an operator may ask Spark to broadcast, for rows of
#: under 100 bytes each. Beyond it the same join runs as a shuffle join.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); where the session has
    none, as in local tests, a temporary folder is set for it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, the
    rows are computed once, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within ``bound``."""
    return F.broadcast(df) if rows <= bound else df


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to at most ``most`` (or one item)."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)




#: Most bytes of an Arrow batch of whole texts that goes to a Python worker.
TEXT_BATCH_BYTES = 2 << 20


def text_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches to ``TEXT_BATCH_BYTES`` if its bound is larger (64 MB
    by default, held by the JVM and by each worker). Results do not depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    with contextlib.suppress(ValueError):  # a bound with another unit is the user's own
        if int(spark.conf.get(name).removesuffix("b")) > TEXT_BATCH_BYTES:
            spark.conf.set(name, str(TEXT_BATCH_BYTES))


def give_back() -> None:
    """What a task has freed goes back to the system: its worker stays and is used by stages
    with other needs, next to workers of theirs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not the GNU library
        ctypes.CDLL(None).malloc_trim(0)
