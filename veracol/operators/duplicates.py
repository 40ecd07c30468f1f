"""Duplicate counting and removal; every grouping combines before it shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import ROW_ID, data_fields, field_map, groupable, ref, row_count
from ..sources.row_order import with_row_order


def _keys(df: DataFrame, subset: Sequence[str] | None) -> list[Column]:
    fields = field_map(df)
    chosen = data_fields(df) if subset is None else [fields[name] for name in subset]
    return [groupable(field).alias(f"k{i}") for i, field in enumerate(chosen)]


def fingerprint(df: DataFrame, subset: Sequence[str] | None = None) -> list[Column]:
    """128 bits per row from two hashes over different orders, plus which cells are null."""
    fields = field_map(df)
    chosen = data_fields(df) if subset is None else [fields[name] for name in subset]
    cells = [groupable(field) for field in chosen]
    nulls = [column.isNull() for column in cells]
    return [F.xxhash64(*cells, *nulls).alias("k0"), F.xxhash64(F.lit(1), *reversed(nulls), *reversed(cells)).alias("k1")]


def group_sizes(df: DataFrame, subset: Sequence[str] | None = None, method: str = "exact") -> DataFrame:
    """Number of copies ``n`` per distinct row (or key); null equals null.

    ``method='fingerprint'`` shuffles 16 bytes per distinct row instead of the row. Two different
    rows share a fingerprint with probability about rows^2 / 2^129; the default compares the cells.
    """
    keys = fingerprint(df, subset) if method == "fingerprint" else _keys(df, subset)
    if not keys:
        return df.agg(row_count().alias("n"))
    names = [f"k{i}" for i in range(len(keys))]
    return df.select(*keys).groupBy(*names).agg(row_count().alias("n"))


def duplicate_counts(df: DataFrame, subset: Sequence[str] | None = None, method: str = "exact") -> DataFrame:
    """One row: rows beyond the first copy, rows in any group of copies, total rows."""
    n = F.col("n")
    zero = F.lit(0)
    return group_sizes(df, subset, method).agg(
        F.coalesce(F.sum(n - 1), zero).cast("bigint").alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(n > 1, n)), zero).cast("bigint").alias("affected_rows"),
        F.coalesce(F.sum(n), zero).cast("bigint").alias("total_rows"),
    )


def copies_of_keys(df: DataFrame, subset: Sequence[str], limit: int | None = None) -> DataFrame:
    """All rows whose key occurs more than once, sorted by key (the duplicate report's listing)."""
    fields = field_map(df)
    repeated = group_sizes(df, subset).where("n > 1")
    match = None
    for i, name in enumerate(subset):
        same = groupable(fields[name]).eqNullSafe(F.col(f"k{i}"))
        match = same if match is None else match & same
    rows = df.join(repeated, match, "left_semi").orderBy(*[ref(name) for name in subset])
    return rows if limit is None else rows.limit(limit)


def drop_duplicate_rows(
    df: DataFrame, subset: Sequence[str] | None = None, keep: str | bool = "first", order_by: str | None = None
) -> DataFrame:
    """Keep the first, the last or (``keep=False``) no copy of each row or key, in row order.

    One grouping picks the surviving row as ``min_by``/``max_by`` of the whole row, so a hot key
    is reduced inside each task and nothing is joined back. An empty subset changes nothing, an
    unknown column is an error. Rows without an order key come last.
    """
    if subset is not None and not subset:
        return df
    unknown = sorted(set(subset or ()) - {field.name for field in data_fields(df)})
    if unknown:
        raise ValueError(f"unknown deduplication columns: {unknown}")
    carries_order = ROW_ID in df.columns
    if subset is None and keep in ("first", "last") and not carries_order and not _has_maps(df):
        return df.dropDuplicates()
    ordered = with_row_order(df, order_by)
    fields = data_fields(df)
    whole_row = subset is None and not _has_maps(df)
    key_names = {field.name for field in fields} if subset is None else set(subset)
    key_fields = [field for field in fields if field.name in key_names]
    # Key cells travel once, as grouping keys; maps cannot be keys and are carried as well.
    carried = [] if whole_row else [field for field in fields if field.name not in key_names or _is_map(field)]
    payload = F.struct(F.col(ROW_ID).alias("rid"), *[ref(field.name).alias(f"v{i}") for i, field in enumerate(carried)])
    picked = ordered.select(*[groupable(field).alias(f"k{i}") for i, field in enumerate(key_fields)], payload.alias("whole"))
    rid = F.col("whole.rid")
    if whole_row:
        choose = (F.max(rid) if keep == "last" else F.min(rid)).alias("rid")
    else:
        place = F.struct(rid.isNull(), rid)
        choose = (F.max_by("whole", place) if keep == "last" else F.min_by("whole", place)).alias("whole")
    survivors = picked.groupBy(*[f"k{i}" for i in range(len(key_fields))]).agg(choose, row_count().alias("copies"))
    if keep is False:
        survivors = survivors.where("copies = 1")
    place = {field.name: F.col(f"k{i}") for i, field in enumerate(key_fields)}
    place.update({field.name: F.col(f"whole.v{i}") for i, field in enumerate(carried)})
    columns = [place[field.name].alias(field.name) for field in fields]
    if carries_order:
        columns.append((F.col("rid") if whole_row else F.col("whole.rid")).alias(ROW_ID))
    return survivors.select(*columns)


def _is_map(field) -> bool:
    return "map<" in field.dataType.simpleString()


def _has_maps(df: DataFrame) -> bool:
    return any(_is_map(field) for field in data_fields(df))
