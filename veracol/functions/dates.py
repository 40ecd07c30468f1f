"""Mixed-format date parsing by shape: one pattern test, then one strict parse per cell.

A cell's shape is found first and only the matching format is tried, instead of letting every
format fail in turn. Impossible dates become null. Shapes: ISO day, ISO day with time, slash,
dash or dot numeric dates (month first, day first as fallback), month names and ``yyyyMMdd``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .columns import kind
from .text import strip

# English month names, full or abbreviated.
_MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"

# Shape name -> pattern.
SHAPES = {
    "iso": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "iso_time": r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?$",
    "iso_slash": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "numeric": r"^\d{1,2}([/.-])\d{1,2}\1\d{4}$",
    "month_first": rf"(?i)^({_MONTHS})\.?[ -]+\d{{1,2}}(?:st|nd|rd|th)?,?[ -]+\d{{4}}$",
    "day_first": rf"(?i)^\d{{1,2}}(?:st|nd|rd|th)?[ -]+({_MONTHS})\.?,?[ -]+\d{{4}}$",
    "compact": r"^\d{8}$",
}


def shape_of(text: Column) -> Column:
    """Name of the date shape a (stripped) text has, null when it has none."""
    found = None
    for name, pattern in SHAPES.items():
        test = text.rlike(pattern)
        found = F.when(test, name) if found is None else found.when(test, name)
    return found


def _parse(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt))


def _numeric(text: Column, day_first: bool) -> Column:
    unified = F.regexp_replace(text, r"[.-]", "/")
    formats = ["d/M/yyyy", "M/d/yyyy"] if day_first else ["M/d/yyyy", "d/M/yyyy"]
    return F.coalesce(*[_parse(unified, fmt) for fmt in formats])


def _named(text: Column) -> Column:
    """Month-name dates: pull out the parts and parse them in one order."""
    month = F.substring(F.regexp_extract(text, rf"(?i)({_MONTHS})", 1), 1, 3)
    day = F.regexp_extract(text, r"(?i)(?:^|[ -])(\d{1,2})(?:st|nd|rd|th)?(?:,|[ -])", 1)
    year = F.regexp_extract(text, r"(\d{4})$", 1)
    return _parse(F.concat_ws(" ", month, day, year), "MMM d yyyy")


def parse_mixed_text(column: Column, day_first: bool = False) -> Column:
    """Parse each text by its own shape; null when it is not a date."""
    text = strip(column)
    return (
        F.when(text.rlike(SHAPES["iso"]), _parse(text, "yyyy-M-d"))
        .when(text.rlike(SHAPES["numeric"]), _numeric(text, day_first))
        .when(text.rlike(SHAPES["month_first"]) | text.rlike(SHAPES["day_first"]), _named(text))
        .when(text.rlike(SHAPES["iso_time"]), F.try_to_timestamp(text))
        .when(text.rlike(SHAPES["iso_slash"]), _parse(text, "yyyy/M/d"))
        .when(text.rlike(SHAPES["compact"]), _parse(text, "yyyyMMdd"))
    )


def parse_like(column: Column, shape: Column, numeric_day_first: Column) -> Column:
    """Parse only texts of the given shape, with one reading for numeric dates."""
    text = strip(column)
    unified = F.regexp_replace(text, r"[.-]", "/")
    numeric = F.when(numeric_day_first, _parse(unified, "d/M/yyyy")).otherwise(_parse(unified, "M/d/yyyy"))
    return F.when(shape_of(text) == shape, F.when(shape == "numeric", numeric).otherwise(parse_mixed_text(column)))


def reads_day_first(column: Column) -> Column:
    """True for a numeric date that only makes sense with the day first."""
    text = F.regexp_replace(strip(column), r"[.-]", "/")
    return _parse(text, "M/d/yyyy").isNull() & _parse(text, "d/M/yyyy").isNotNull()


def parse_mixed(column: Column, dtype: T.DataType, day_first: bool = False) -> Column:
    """Timestamp of a column of any type; numbers count nanoseconds since 1970."""
    family = kind(dtype)
    if family == "text":
        return parse_mixed_text(column, day_first)
    if family == "datetime":
        return column.cast("timestamp")
    if family == "numeric":
        return F.timestamp_micros((column / F.lit(1000)).cast("bigint"))
    return F.lit(None).cast("timestamp")


def to_iso(column: Column, dtype: T.DataType, day_first: bool = False, output_format: str = "yyyy-MM-dd") -> Column:
    return F.date_format(parse_mixed(column, dtype, day_first), output_format)
