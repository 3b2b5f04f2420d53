"""The sales-order data model the jobs are written against, as explicit
schemas, and a projection that brings any extract of a table into it.

Types follow the use in the reference's queries: codes and texts are
strings, dates are dates, quantities ``decimal(18,3)``, amounts
``decimal(18,2)``; ``FILE_DATE`` is the load (version) date of a snapshot
table. Nothing is inferred from data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, D = T.StringType(), T.DateType()
QTY, AMOUNT = T.DecimalType(18, 3), T.DecimalType(18, 2)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


# Table and column names of the model.
MODEL: dict[str, T.StructType] = {
    # order header, one row per order and load
    "VBAK": _schema(("VBELN", S), ("AUDAT", D), ("AUART", S), ("KUNNR", S), ("LFSTK", S),
                    ("GBSTK", S), ("NETWR", AMOUNT), ("WAERK", S), ("FILE_DATE", D)),
    # schedule line, one row per order line and load
    "VBEP": _schema(("VBELN", S), ("POSNR", S), ("EDATU", D), ("WMENG", QTY), ("LMENG", QTY),
                    ("FILE_DATE", D)),
    # invoice header
    "VBRK": _schema(("VBELN", S), ("FKART", S), ("WAERK", S), ("FKDAT", D), ("FILE_DATE", D)),
    # invoice line
    "VBRP": _schema(("VBELN", S), ("POSNR", S), ("MATNR", S), ("FKIMG", QTY), ("NETWR", AMOUNT),
                    ("FILE_DATE", D)),
    # product and product text
    "MARA": _schema(("MATNR", S), ("MATKL", S)),
    "MAKT": _schema(("MATNR", S), ("SPRAS", S), ("MAKTX", S)),
    # material group -> category (an input of ours; not in the reference)
    "CATEGORY_MAP": _schema(("MATKL", S), ("CATEGORY", S)),
}


def schema(table: str) -> T.StructType:
    """The model schema of ``table`` (e.g. ``"VBAK"``)."""
    return MODEL[table]


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select the model columns of ``table`` from ``df`` and cast them to the
    model types (other columns are dropped; a missing column is an error).

    A plain projection: Catalyst still prunes columns and pushes filters through
    it. A load date stored as text is cast here, so a floor on it cannot prune
    load-date folders; store the column as a date (``write_versioned``) for that.
    Under ANSI mode a value that does not fit its type fails the job rather
    than turning into NULL.
    """
    missing = [f.name for f in MODEL[table].fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{table}: missing columns {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in MODEL[table].fields])
