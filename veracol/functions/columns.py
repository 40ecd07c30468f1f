"""Column references, type families and wide-aggregate helpers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

ROW_ID = "__rid"

# Aggregates per generated method: wider passes outgrow the JVM method limit and lose codegen.
AGGREGATES_PER_PASS = 60


def ref(name: str) -> Column:
    """Reference a column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind(dtype: T.DataType) -> str:
    """Type family: boolean, numeric, text, datetime or other."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "text"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "other"


def data_fields(df: DataFrame) -> list[T.StructField]:
    """The table's own fields, without the row id."""
    return [field for field in df.schema.fields if field.name != ROW_ID]


def fields_of(df: DataFrame, *kinds: str) -> list[T.StructField]:
    return [field for field in data_fields(df) if kind(field.dataType) in kinds]


def field_map(df: DataFrame) -> dict[str, T.StructField]:
    return {field.name: field for field in data_fields(df)}


def cell(field: T.StructField) -> Column:
    """A column's value with NaN read as missing."""
    column = ref(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column)
    return column


def nan_to_null(df: DataFrame) -> DataFrame:
    """Map NaN to null once, so that missing has a single spelling downstream."""
    if not any(isinstance(f.dataType, (T.DoubleType, T.FloatType)) for f in df.schema.fields):
        return df
    return df.select(*[cell(field).alias(field.name) for field in df.schema.fields])


def groupable(field: T.StructField) -> Column:
    """A value usable as a grouping key; maps are not comparable, so their entries are."""
    if isinstance(field.dataType, T.MapType):
        return F.array_sort(F.map_entries(ref(field.name)))
    return cell(field)


def as_text(field: T.StructField) -> Column:
    """A value as text, one spelling per distinct value."""
    column = cell(field)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        column = column + F.lit(0.0)  # -0.0 and 0.0 are one value
    if isinstance(field.dataType, T.BooleanType):
        return F.when(column, "True").when(~column, "False")
    if kind(field.dataType) == "other" and not isinstance(field.dataType, T.BinaryType):
        return F.to_json(column) if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)) else column.cast("string")
    return column.cast("string")


def count_where(predicate: Column) -> Column:
    """Number of rows for which the predicate is true (null counts as false)."""
    return F.count(F.when(predicate, F.lit(1)))


def row_count() -> Column:
    return F.count(F.lit(1))


def chunks(items: Sequence[Any], size: int) -> Iterable[Sequence[Any]]:
    for start in range(0, len(items), size):
        yield items[start : start + size]


def aggregate_long(
    df: DataFrame,
    items: Sequence[tuple[dict[str, Any], dict[str, Column]]],
    per_pass: int = AGGREGATES_PER_PASS,
) -> DataFrame:
    """Fuse many aggregates into few passes and return one output row per item.

    ``items`` holds (labels, measures); every item has the same label and measure names. One pass
    scans only the columns its measures mention.
    """
    measures_per_item = max(1, len(items[0][1]))
    frames = []
    for part in chunks(items, max(1, per_pass // measures_per_item)):
        aggregates, rows = [], []
        for position, (labels, measures) in enumerate(part):
            cells = [label_literal(value).alias(name) for name, value in labels.items()]
            for name, measure in measures.items():
                slot = f"m{position}_{name}"
                aggregates.append(measure.alias(slot))
                cells.append(F.col(slot).alias(name))
            rows.append(F.struct(*cells))
        frames.append(df.agg(*aggregates).select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, frames)


def label_literal(value: Any) -> Column:
    return F.lit(None).cast("string") if value is None else F.lit(value)


def ratio_percent(part: Column, whole: Column) -> Column:
    """part / whole * 100 without rounding, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part, whole) * F.lit(100.0), F.lit(0.0))
