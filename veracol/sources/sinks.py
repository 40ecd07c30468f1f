"""Sinks: immutable Parquet snapshots, formula-safe CSV, JSON rows and star-schema files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import ROW_ID, fields_of, ref
from ..functions.text import guard_formula

# Written so that a plain CSV reader gets back what was written: quotes doubled, blanks kept.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "encoding": "UTF-8",
}


def without_row_id(df: DataFrame) -> DataFrame:
    return df.drop(ROW_ID)


def write_snapshot(df: DataFrame, path: str) -> None:
    """An immutable Parquet version: writing to an existing path is an error."""
    without_row_id(df).write.mode("errorifexists").parquet(path)


def formula_safe(df: DataFrame) -> DataFrame:
    """Quote text cells a spreadsheet would evaluate; numbers are left alone."""
    texts = {field.name for field in fields_of(df, "text")}
    return df.select(*[guard_formula(ref(name)).alias(name) if name in texts else ref(name) for name in df.columns if name != ROW_ID])


def write_safe_csv(df: DataFrame, path: str) -> None:
    formula_safe(df).write.options(**CSV_OPTIONS).csv(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, nulls kept."""
    return df.select(F.to_json(F.struct(*[ref(name) for name in df.columns]), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def write_tables(tables: Mapping[str, DataFrame], root: str, fmt: str = "csv") -> None:
    """One folder per table, as CSV with headers or Parquet."""
    for name, table in tables.items():
        writer = table.write.mode("errorifexists")
        if fmt == "csv":
            writer.options(**CSV_OPTIONS).csv(f"{root}/{name}")
        else:
            writer.parquet(f"{root}/{name}")
