"""Lenient casts: a value that does not fit becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .columns import kind
from .text import strip

# Text accepted as a number; Spark alone would also take Java suffixes such as ``1d``.
NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"


def to_double(column: Column, dtype: T.DataType) -> Column:
    """Double of a column; booleans and the words true/false are 1 and 0; NaN is null."""
    if kind(dtype) == "boolean":
        value = column.cast("double")
    elif kind(dtype) == "text":
        text = strip(column)
        lowered = F.lower(text)
        value = (
            F.when(lowered == "true", F.lit(1.0))
            .when(lowered == "false", F.lit(0.0))
            .when(text.rlike(NUMBER), text.try_cast("double"))
        )
    elif kind(dtype) == "numeric":
        value = column.cast("double")
    elif kind(dtype) == "datetime":
        value = F.unix_micros(column.cast("timestamp")).cast("double") * F.lit(1000.0)
    else:
        value = F.lit(None).cast("double")
    return F.when(~F.isnan(value), value)


def to_long(column: Column, dtype: T.DataType) -> Column:
    """Whole numbers as bigint; integral columns are not routed through doubles."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return column.cast("bigint")
    value = to_double(column, dtype)
    if kind(dtype) == "text":
        return F.coalesce(F.when(strip(column).rlike(r"^[+-]?\d+$"), strip(column).try_cast("bigint")), value.try_cast("bigint"))
    return value.try_cast("bigint")


def is_fractional(column: Column, dtype: T.DataType) -> Column:
    """True for a number that a whole-number cast cannot keep (fractions and infinities)."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return F.lit(False)
    value = to_double(column, dtype)
    return value.isNotNull() & ((value != F.floor(value)) | (F.abs(value) == F.lit(float("inf"))))
