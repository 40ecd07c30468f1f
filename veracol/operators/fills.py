"""Forward and backward fill in row order, distributed.

A window without a partition key would sort the whole table in one task. The order is cut
into consecutive blocks of bounded size instead; each block fills on its own, and the value that
enters it from earlier blocks is read from a table with one row per block. Rows that tie on the
order key follow a second key, and a key (or the lack of one) that very many rows share is cut along that.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import ROW_ID, cell, data_fields, field_map, groupable, ref, row_count
from ..functions.frames import small_table
from ..sources.row_order import order_key, with_row_order

ROWS_PER_BLOCK = 2_000_000
MAX_BLOCKS = 100_000
_BLOCK = "__block"
_TIE = "__tie"


def order_blocks(df: DataFrame, rows_per_block: int = ROWS_PER_BLOCK, tie: str | None = None) -> DataFrame:
    """Add a block number that rises with the row id; dense stretches are cut again.

    A stretch of one row id is cut along the bigint column ``tie``, if there is one. Rows without an id come last, in
    blocks of their own. The sizes inspected on the driver are one row per block, at most ``MAX_BLOCKS``.
    """
    second = F.lit(0) if tie is None else F.col(tie)
    rows, low, high = df.agg(row_count(), F.min(ROW_ID), F.max(ROW_ID)).first()
    if not rows:
        return df.withColumn(_BLOCK, F.lit(0).cast("bigint"))
    low, high = low or 0, high or 0
    spark = df.sparkSession
    wanted = min(MAX_BLOCKS // 4, max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_block)))
    rows_per_block = max(rows_per_block, -(-rows // wanted))
    width = (high - low) // wanted + 1
    cut = df.withColumn(_BLOCK, F.expr(f"coalesce((`{ROW_ID}` - {low}L) div {width}L, {wanted}L)"))
    while True:
        found = [row_count().alias("n"), F.min(ROW_ID).alias("low"), F.max(ROW_ID).alias("high"), F.min(second).alias("least"), F.max(second).alias("most")]
        sizes = cut.groupBy(_BLOCK).agg(*found).orderBy(_BLOCK).collect()
        if all(s["n"] <= 4 * rows_per_block or (s["high"] == s["low"] and s["most"] == s["least"]) for s in sizes):
            return cut
        plan, base = [], 0
        for s in sizes:
            along_tie = s["high"] == s["low"]
            first, last = (s["least"], s["most"]) if along_tie else (s["low"], s["high"])
            parts = -(-s["n"] // rows_per_block) * (4 if s["n"] > 4 * rows_per_block else 1)
            step = (last - first) // parts + 1
            plan.append((s[_BLOCK], along_tie, first, step, base))
            base += (last - first) // step + 1
        lookup = F.broadcast(small_table(spark, plan, f"{_BLOCK} bigint, __along_tie boolean, __low bigint, __step bigint, __base bigint"))
        names = [ref(name) for name in cut.columns if name != _BLOCK]
        place = F.when(F.col("__along_tie"), second).otherwise(F.col(ROW_ID)).alias("__place")
        located = cut.join(lookup, _BLOCK, "left").select(*names, place, "__low", "__step", "__base")
        cut = located.select(*names, F.expr("__base + (__place - __low) div __step").alias(_BLOCK))


def fill_in_order(
    df: DataFrame, directions: Mapping[str, str], order_by: str | None = None, rows_per_block: int = ROWS_PER_BLOCK, then_by: str | None = None
) -> DataFrame:
    """Fill each named column ``ffill`` (previous value) or ``bfill`` (next value) in row order.

    Rows without an order key come after all others. Rows of one key, or of none, are in the order of the integer, date or
    timestamp column ``then_by``, its nulls first; by default in that of a hash of the row, so that the result does not depend on how rows are dealt.
    """
    fields = field_map(df)
    directions = {name: way for name, way in directions.items() if name in fields}
    if not directions:
        return df
    # a quarter of the hashes' range: differences fit in a bigint
    tie = F.coalesce(order_key(df, then_by), F.lit(-(1 << 61))) if then_by else F.shiftright(F.xxhash64(*[groupable(field) for field in data_fields(df)]), 2)
    had_order = ROW_ID in df.columns
    cut = order_blocks(with_row_order(df, order_by).withColumn(_TIE, tie), rows_per_block, _TIE)

    def filled_key(name: str) -> Column:
        return F.when(cell(fields[name]).isNotNull(), F.struct(ROW_ID, _TIE))

    edges, entering = [], []
    # Running frames are linear; a backward fill is a forward fill over the reversed order.
    before = {"ffill": Window.orderBy(_BLOCK), "bfill": Window.orderBy(F.desc(_BLOCK))}
    for i, (name, way) in enumerate(directions.items()):
        pick = F.max_by if way == "ffill" else F.min_by
        edges.append(pick(cell(fields[name]), filled_key(name)).alias(f"__e{i}"))
        carried = F.last(f"__e{i}", ignorenulls=True).over(before[way].rowsBetween(Window.unboundedPreceding, -1))
        entering.append(carried.alias(f"__in{i}"))
    # One row per block (at most MAX_BLOCKS), hence the window over all of them. The join is on the
    # key the window below partitions by, so it costs no shuffle of its own.
    carry = cut.groupBy(_BLOCK).agg(*edges).select(_BLOCK, *entering)
    joined = cut.join(carry, _BLOCK)

    block = Window.partitionBy(_BLOCK)
    inside = {"ffill": block.orderBy(ROW_ID, _TIE), "bfill": block.orderBy(F.desc(ROW_ID), F.desc(_TIE))}
    slots = {name: i for i, name in enumerate(directions)}
    columns = []
    for name in df.columns:
        if name not in slots:
            columns.append(ref(name))
            continue
        value = cell(fields[name])
        near = F.last(value, ignorenulls=True).over(inside[directions[name]].rowsBetween(Window.unboundedPreceding, Window.currentRow))
        columns.append(F.coalesce(near, F.col(f"__in{slots[name]}")).alias(name))
    if not had_order:
        columns = [column for column, name in zip(columns, df.columns) if name != ROW_ID]
    return joined.select(*columns)
