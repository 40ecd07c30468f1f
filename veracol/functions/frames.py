"""Small driver-side rows as a local relation, whose size the optimizer knows."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

_ARROW = {
    "string": pa.string(),
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "timestamp": pa.timestamp("us", tz="UTC"),
    "array<string>": pa.list_(pa.string()),
}


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A frame of a few rows; no tasks are needed to produce it."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    arrow = [_ARROW.get(field.dataType.simpleString()) for field in fields]
    if any(kind is None for kind in arrow):
        return spark.createDataFrame(list(rows), schema)
    columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(arrow)]
    return spark.createDataFrame(pa.table(columns, names=[field.name for field in fields]))
