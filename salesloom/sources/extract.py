"""The month x category sales extract as CSV (S6 read, S7 write).

The file has a header, UTF-8 text (a leading byte-order mark is skipped by
the reader), CRLF line ends and four columns. The schema is always given:
inference would turn ``2025-01`` into a timestamp and the money into doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import ascending

EXTRACT_SCHEMA = T.StructType(
    [
        T.StructField("YEARMONTH", T.StringType()),
        T.StructField("CATEGORY", T.StringType()),
        T.StructField("QTY", T.DecimalType(18, 3)),
        T.StructField("NET_USD", T.DecimalType(18, 2)),
    ]
)


def read_extract(spark: SparkSession, path: str) -> DataFrame:
    """The extract with its fixed schema."""
    return (
        spark.read.option("header", True)
        .option("encoding", "UTF-8")
        .option("mode", "FAILFAST")
        .schema(EXTRACT_SCHEMA)
        .csv(path)
    )


def write_extract(df: DataFrame, path: str, mode: str = "overwrite", bom: bool = False) -> None:
    """Write the extract ordered by month, then category, with CRLF ends.
    ``bom`` puts a byte-order mark before each file's header, as spreadsheets
    want it.

    The global sort range-partitions the rows, so the part files, read in name
    order, are already in month/category order; no single task has to hold
    the whole extract.
    """
    ordered = df.orderBy(*ascending("YEARMONTH", "CATEGORY"))
    if bom:
        first, *rest = df.columns
        ordered = ordered.select(F.col(first).alias("\ufeff" + first), *rest)
    (
        ordered.write.mode(mode)
        .option("header", True)
        .option("lineSep", "\r\n")
        .csv(path)
    )


#: The stored extract's columns, with the sums' full precision.
TABLE_SCHEMA = T.StructType(
    [
        T.StructField("CATEGORY", T.StringType()),
        T.StructField("QTY", T.DecimalType(38, 3)),
        T.StructField("NET_USD", T.DecimalType(38, 2)),
        T.StructField("YEARMONTH", T.StringType()),
    ]
)


def write_extract_table(df: DataFrame, path: str) -> None:
    """K13 stored for the dashboard: Parquet, a folder per month, so a slice
    reads the months of its range only and the facts are read once for all
    slices. Rows are clustered by month; AQE splits a large month."""
    columns = TABLE_SCHEMA.fieldNames()
    df.select(*columns).hint("rebalance", "YEARMONTH").write.partitionBy("YEARMONTH").parquet(path)


def read_extract_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored extract in the extract's column order. The schema is given:
    a month such as ``2025-01`` must stay text."""
    return spark.read.schema(TABLE_SCHEMA).parquet(path).select("YEARMONTH", "CATEGORY", "QTY", "NET_USD")
