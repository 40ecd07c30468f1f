"""Long-form value counts: one shuffle serves distinct counts, top values, modes and casing.

All columns are unpivoted to (column, value) and grouped once. Partial aggregation runs before
the shuffle, so a value that fills a third of the table arrives as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import ROW_ID, aggregate_long, as_text, cell, field_map, ref
from ..functions.frames import small_table
from ..sources.row_order import with_row_order


def unpivot_cells(df: DataFrame, cells: Sequence[tuple[str, Column]], carry: Sequence[str] = ()) -> DataFrame:
    """Rows of (column_name, value, *carry) for cells of one type; nulls are left out."""
    wide = df.select(*carry, *[column.alias(name) for name, column in cells])
    long = wide.unpivot(list(carry), [ref(name) for name, _ in cells], "column_name", "value")
    return long.where(F.col("value").isNotNull()).select("column_name", "value", *carry)


def value_counts(df: DataFrame, columns: Sequence[str], order_by: str | None = None, transform=None, grouping: str = "exact") -> DataFrame:
    """(column_name, value, n, first_seen) over the non-null values of the columns, as text.

    With ``grouping='fingerprint'`` the value is its MD5, so that long texts are not shuffled;
    ``texts_behind`` gives the texts of chosen ones.
    """
    fields = field_map(df)
    ordered = with_row_order(df, order_by)
    change = transform or (F.md5 if grouping == "fingerprint" else (lambda column: column))
    long = unpivot_cells(ordered, [(name, change(as_text(fields[name]))) for name in columns], [ROW_ID])
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"), F.min(ROW_ID).alias("first_seen"))


def texts_behind(df: DataFrame, chosen: Sequence[tuple[str, str]]) -> dict[tuple[str, str], str]:
    """Text of each chosen (column, MD5): a scan that keeps one text per digest and task."""
    if not chosen:
        return {}
    fields = field_map(df)
    listed = F.broadcast(small_table(df.sparkSession, chosen, "column_name string, digest string"))
    cells = unpivot_cells(df, [(name, as_text(fields[name])) for name in dict.fromkeys(name for name, _ in chosen)])
    hits = cells.withColumn("digest", F.md5("value")).join(listed, ["column_name", "digest"])
    return {(row[0], row[1]): row[2] for row in hits.groupBy("column_name", "digest").agg(F.first("value")).collect()}


def top_values(counts: DataFrame, limit: int, ties: str = "first_seen") -> DataFrame:
    """The most frequent values per column. Each task keeps ``limit`` rows per column before the shuffle."""
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc(ties), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column, columns without values included as 0.

    Columns are unpivoted by type family, so numbers and times are grouped as fixed-width keys.
    """
    fields = field_map(df)
    if approximate:
        items = [({"column_name": name}, {"unique_count": F.approx_count_distinct(cell(fields[name]))}) for name in columns]
        return aggregate_long(df, items)
    families: dict[str, list[tuple[str, Column]]] = {}
    for name in columns:
        family, key = _distinct_key(fields[name])
        families.setdefault(family, []).append((name, key))
    counted = None
    for cells in families.values():
        values = unpivot_cells(df, cells).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
        found = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("found"))
        counted = found if counted is None else counted.unionByName(found)
    # Grouping a column with no values yields nothing, so every name is kept by an outer join with the list.
    names = small_table(df.sparkSession, [(name,) for name in columns], "column_name string")
    return names.join(counted, "column_name", "left").select("column_name", F.coalesce("found", F.lit(0)).cast("bigint").alias("unique_count"))


def _distinct_key(field: T.StructField) -> tuple[str, Column]:
    """Type family and a value of that family, one per distinct value of the column."""
    dtype, value = field.dataType, cell(field)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "long", value.cast("bigint")
    if isinstance(dtype, T.DateType):
        return "long", F.unix_date(value).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return "long", F.unix_micros(value)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double", value.cast("double") + F.lit(0.0)
    return "text", as_text(field)


def mode_of(df: DataFrame, column: str):
    """Most frequent non-null value, the smallest on ties; None when there is none."""
    field = field_map(df)[column]
    value = cell(field).alias("value")
    rows = df.select(value).where(F.col("value").isNotNull()).groupBy("value").count().orderBy(F.desc("count"), F.asc("value")).take(1)
    return rows[0]["value"] if rows else None
