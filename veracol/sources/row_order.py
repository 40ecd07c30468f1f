"""Explicit row order. Spark rows have none, yet keep-first, samples and fills need one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import ROW_ID, ref
from ..functions.frames import small_table

# File positions are joined by broadcast up to this many files.
BROADCAST_FILES = 50_000


def order_key(df: DataFrame, order_by: str) -> Column:
    """A bigint that sorts like the given natural key."""
    dtype = df.schema[order_by].dataType
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return ref(order_by).cast("bigint")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(ref(order_by).cast("timestamp"))
    if isinstance(dtype, T.DateType):
        return F.unix_date(ref(order_by)).cast("bigint")
    raise ValueError(f"row order needs an integer, date or timestamp column, not {dtype.simpleString()}")


def with_row_order(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """Add the bigint row id: an existing one is kept, else a natural key, else scan order."""
    if ROW_ID in df.columns:
        return df
    key = order_key(df, order_by) if order_by else F.monotonically_increasing_id()
    return df.withColumn(ROW_ID, key)


def read_parquet_in_order(spark, path: str, *more: str) -> DataFrame:
    """Parquet rows with an id by (file name, position in file).

    The id depends on the files alone, not on how a run splits them, so it is the same in every
    job even when executors come and go.
    """
    df = spark.read.parquet(path, *more)
    files = sorted(df.inputFiles())
    columns = [ref(name) for name in df.columns]
    if len(files) <= 1:
        return df.select(*columns, F.col("_metadata.row_index").alias(ROW_ID))
    numbered = small_table(spark, list(enumerate(files)), "__file bigint, __path string")
    if len(files) <= BROADCAST_FILES:
        numbered = F.broadcast(numbered)
    located = df.select(*columns, F.col("_metadata.file_path").alias("__at"), F.col("_metadata.row_index").alias("__row"))
    joined = located.join(numbered, F.expr("replace(__at, 'file:///', 'file:/') = replace(__path, 'file:///', 'file:/')"))
    return joined.select(*columns, (F.col("__file") * F.lit(1 << 40) + F.col("__row")).alias(ROW_ID))
