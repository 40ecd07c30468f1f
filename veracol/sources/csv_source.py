"""CSV scan with inferred types: integer, then float, then true/false, else text, per column."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.casts import NUMBER
from ..functions.columns import AGGREGATES_PER_PASS, ROW_ID, chunks, count_where, ref
from ..functions.frames import small_table
from ..session import cut_lineage

# The spellings of a missing cell.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
_READ_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "encoding": "UTF-8",
}


# What follows a quote that opens a cell, and a run of whole cells, each with its comma. Nothing is given back, so the time is linear.
_QUOTED = r'(?:[^"]++|"")*+'
_CELLS = rf'(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+)?+,)*+'
# A line that begins outside of quotes, or inside, and ends inside. A quote opens a cell only at its beginning.
OPENS = rf'^{_CELLS}"{_QUOTED}\z'
STAYS_OPEN = rf'^{_QUOTED}(?:"[^,]*+,{_CELLS}"{_QUOTED})?+\z'
SURPLUS = "__surplus"


class MalformedCsv(ValueError):
    """A file with a quote that is never closed, or with rows of more cells than the header has."""


def has_quoted_line_breaks(spark, path: str | Sequence[str]) -> bool:
    """True if some line ends inside of a quoted cell that it opened."""
    return not spark.read.text(path).where(F.col("value").rlike(OPENS)).isEmpty()


def _at_block(order: str = "__mid") -> Window:
    return Window.partitionBy("__path", "__start").orderBy(order)


def _state(base: Column, swaps: Column, entering: Column) -> Column:
    """Whether a quote is open: by the last line that decides it alone and the lines since that turn it over."""
    return F.when(base.isNotNull(), (base["v"] + swaps - base["swaps"]) % 2).otherwise((entering + swaps) % 2)


def csv_records(spark, path: str | Sequence[str]) -> DataFrame:
    """(path, line, record) of all files: whole records, however many lines their quoted cells span.

    Every line turns the state (a quote is open or not) into another: it leaves it, turns it over, or decides it. Composed first within
    each split of a file, then over the splits, this gives the state before each line; lines of one record are joined, all others stay
    where they are. Splits are read by different tasks. ``line`` is the number of the record's first line. Line breaks inside of cells
    are kept as they are. A file whose last quote is open is refused.
    """
    lines = spark.read.option("lineSep", "\n").text(path if isinstance(path, str) else list(path))
    lines = lines.select(file_path().alias("__path"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__mid"), "value")
    out0, out1 = (F.col("value").rlike(p).cast("int") for p in (OPENS, STAYS_OPEN))
    lines = lines.withColumns({"out0": out0, "out1": out1}).withColumn("swap", ((F.col("out0") == 1) & (F.col("out1") == 0)).cast("int"))
    earlier = _at_block().rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumns({"swaps": F.coalesce(F.sum("swap").over(earlier), F.lit(0)), "at": F.row_number().over(_at_block()) - 1})
    decides = F.when(F.col("out0") == F.col("out1"), F.struct(F.col("out0").alias("v"), F.col("swaps")))
    lines = cut_lineage(lines.withColumn("base", F.last(decides, ignorenulls=True).over(earlier)).withColumn("after", F.struct(F.coalesce(decides, F.col("base")).alias("base"), (F.col("swaps") + F.col("swap")).alias("swaps"))))

    # one row for each split
    blocks = lines.groupBy("__path", "__start").agg(F.count(F.lit(1)).alias("n"), F.max_by("after", "at").alias("after"))
    file = Window.partitionBy("__path").orderBy("__start")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    turned = F.when(F.col("after.base").isNull(), F.col("after.swaps") % 2).otherwise(0)
    blocks = blocks.withColumns({"turns": turned, "before": F.coalesce(F.sum("n").over(before), F.lit(0))})
    blocks = blocks.withColumn("turned", F.coalesce(F.sum("turns").over(before), F.lit(0)))
    fixed = F.when(F.col("after.base").isNotNull(), F.struct(_state(F.col("after.base"), F.col("after.swaps"), F.lit(0)).alias("v"), F.col("turned").alias("swaps")))
    blocks = blocks.withColumn("entering", _state(F.last(fixed, ignorenulls=True).over(before), F.col("turned"), F.lit(0)))
    blocks = cut_lineage(blocks.withColumn("leaving", _state(F.col("after.base"), F.col("after.swaps"), F.col("entering"))).withColumn("last", F.lead("n").over(file).isNull()))
    unclosed = [row["__path"] for row in blocks.where("last AND leaving = 1").select("__path").take(5)]
    if unclosed:
        raise MalformedCsv(f"a quote is not closed in {', '.join(unclosed)}")

    known = lines.join(blocks.select("__path", "__start", "before", "entering"), ["__path", "__start"])
    known = known.select("__path", "__start", (F.col("before") + F.col("at")).alias("line"), "value", "out0", (_state(F.col("base"), F.col("swaps"), F.col("entering")) == 0).alias("starts"))
    whole = F.col("starts") & (F.col("out0") == 0)
    single = known.where(whole).select("__path", "line", F.col("value").alias("record"))
    parts = cut_lineage(known.where(~whole).withColumn("nth", F.sum(F.col("starts").cast("int")).over(_at_block("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    begun = parts.groupBy("__path", "__start").agg(F.max("nth").alias("begun"))
    begun = begun.select("__path", "__start", F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("earlier"))
    joined = parts.join(begun, ["__path", "__start"]).groupBy("__path", (F.col("earlier") + F.col("nth")).alias("nth"))
    joined = joined.agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", "value"))).alias("parts"))
    joined = joined.select("__path", "line", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record"))
    records = single.unionByName(joined).select(F.col("__path").alias("path"), "line", F.regexp_replace("record", "\r$", "").alias("record"))
    return records.where(F.trim("record") != "")


def _header(line: str) -> list[str]:
    """Column names of a header; empty ones and repeated ones get their places, as Spark's reader does."""
    cells = next(csv.reader([line.removeprefix("\ufeff")]), [])
    return [f"_c{i}" if not c else (f"{c}{i}" if cells.count(c) > 1 else c) for i, c in enumerate(cells)]


def _cells_of_records(spark, path) -> DataFrame:
    """Cells of ``csv_records`` as text, with the record's file and line and any cells beyond the header's."""
    records = cut_lineage(csv_records(spark, path))
    first = records.groupBy("path").agg(F.min("line").alias("line"))
    heads = records.join(first, ["path", "line"]).orderBy("path").select("record").limit(1).collect()
    names = _header(heads[0]["record"]) if heads else []
    schema = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    body = records.join(first.withColumnRenamed("line", "head"), "path").where("line > head")
    options = {k: v for k, v in _READ_OPTIONS.items() if k not in ("header", "encoding")} | {"multiLine": "true", "maxCharsPerColumn": "-1"}
    parsed = body.select("path", "line", F.from_csv("record", schema, options).alias("c"))
    return parsed.select(F.col("path").alias("__path"), F.col("line").alias("__line"), *[F.col(f"c.c{i}").alias(name) for i, name in enumerate([*names, SURPLUS])])


def malformed_rows(spark, path: str | Sequence[str]) -> DataFrame:
    """(path, rows, surplus_rows): rows of each file, and those with more cells than the header."""
    cells = read_csv_parts(spark, path, order=False)
    return cells.groupBy(F.col("__path").alias("path")).agg(F.count(F.lit(1)).alias("rows"), F.count(ref(SURPLUS)).alias("surplus_rows"))


def read_csv_text(spark, path: str | Sequence[str], multiline: bool | None = None, na_tokens=NA_TOKENS) -> DataFrame:
    """All cells as text, missing spellings as null, rows numbered by file and line; files have one header.

    Records with line breaks inside quotes are put together first (``csv_records``). Unless ``multiline`` says whether there are any, a scan
    of the lines finds out. Cells beyond the header's are left out.
    """
    return read_csv_parts(spark, path, multiline, na_tokens).drop("__path", SURPLUS)


def read_csv_parts(spark, path: str | Sequence[str], multiline: bool | None = None, na_tokens=NA_TOKENS, order: bool = True) -> DataFrame:
    """``read_csv_text`` with each row's file as ``__path`` and the first cell beyond the header as ``__surplus``.

    Without ``order`` the row id is left out, and with it the count of each split's rows that it takes.
    """
    paths = path if isinstance(path, str) else list(path)
    if multiline is None:
        multiline = has_quoted_line_breaks(spark, paths)
    if multiline:
        raw = _cells_of_records(spark, paths)
        names, located = raw.columns[2:-1], raw
    else:
        names = spark.read.options(**_READ_OPTIONS).csv(paths).columns
        schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, SURPLUS]])
        raw = spark.read.schema(schema).options(**_READ_OPTIONS).csv(paths)
        numbered = raw.select(*[ref(n) for n in names], ref(SURPLUS), file_path().alias("__path"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__mid"))
        located = numbered
    cells = [F.when(~ref(name).isin(*na_tokens), ref(name)).alias(name) for name in names]
    if not order:
        return located.select(*cells, ref(SURPLUS), "__path")
    if not multiline:
        blocks = numbered.groupBy("__path", "__start").agg(F.min("__mid").alias("__first"), F.count(F.lit(1)).alias("__n"))
        before = F.sum("__n").over(Window.partitionBy("__path").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1))
        blocks = blocks.select("__path", "__start", "__first", F.coalesce(before, F.lit(0)).alias("__before"))  # one row for each split
        located = numbered.join(blocks, ["__path", "__start"]).withColumn("__line", F.col("__mid") - F.col("__first") + F.col("__before"))
    files = sorted(spark.read.text(paths).inputFiles())
    place = F.lit(0)
    if len(files) > 1:
        listed = small_table(spark, [(f"file:/{unquote(f).removeprefix('file:').lstrip('/')}" if f.startswith("file:") else unquote(f), i) for i, f in enumerate(files)], "__path string, __file bigint")
        located, place = located.join(listed, "__path"), F.col("__file")
    return located.select(*cells, ref(SURPLUS), "__path", (place * F.lit(1 << 40) + F.col("__line")).cast("bigint").alias(ROW_ID))


def file_path() -> Column:
    """The path of a row's file, as file listings spell it."""
    escaped = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.regexp_replace(F.url_decode(escaped), "^file:/+", "file:/")


def read_csv_files(spark, paths: Sequence[str], multiline: bool | None = None, na_tokens=NA_TOKENS) -> DataFrame:
    """``read_csv_text`` of files with one header, with each row's file as ``__path``."""
    return read_csv_parts(spark, list(paths), multiline, na_tokens).drop(SURPLUS)


def grouped_types(df: DataFrame) -> dict[str, dict[str, str]]:
    """``infer_types`` of every file of ``read_csv_files``, from groupings by file."""
    names = [name for name in df.columns if name not in (ROW_ID, "__path")]
    types: dict[str, dict[str, str]] = {}
    for part in chunks(names, AGGREGATES_PER_PASS // 4):
        for row in df.groupBy("__path").agg(*_type_measures(part)).collect():
            types.setdefault(row["__path"], {}).update(_narrowest(row, part))
    return types


def _as_int(column: Column) -> Column:
    return F.when(F.btrim(column).rlike(r"^[+-]?\d{1,19}$"), F.btrim(column).try_cast("bigint"))


def _as_double(column: Column) -> Column:
    return F.when(F.btrim(column).rlike(NUMBER), F.btrim(column).try_cast("double"))


def _as_bool(column: Column) -> Column:
    """Only the words true and false; Spark's own cast also takes 1, y and t."""
    return F.when(column.isin("true", "True", "TRUE"), F.lit(True)).when(column.isin("false", "False", "FALSE"), F.lit(False))


_READERS = {"bigint": _as_int, "double": _as_double, "boolean": _as_bool}


def infer_types(df: DataFrame, path: str | Sequence[str] = "") -> dict[str, str]:
    """Narrowest type every non-null cell of a column reads as; one scan per 15 columns. Surplus cells are an error."""
    names = [name for name in df.columns if name not in (ROW_ID, SURPLUS)]
    surplus = F.count(ref(SURPLUS)) if SURPLUS in df.columns else F.lit(0)
    types: dict[str, str] = {}
    for part in chunks(names, AGGREGATES_PER_PASS // 4):
        row = df.agg(*_type_measures(part), surplus.alias("surplus")).first()
        if row["surplus"]:
            raise MalformedCsv(f"{row['surplus']:,} rows have more cells than the header of {path}")
        types |= _narrowest(row, part)
    return types


def _type_measures(names: Sequence[str]) -> list[Column]:
    """For each column the number of its cells, and of those that each type cannot read."""
    measures = []
    for i, name in enumerate(names):
        column = ref(name)
        measures.append(F.count(column).alias(f"n{i}"))
        measures += [count_where(column.isNotNull() & reader(column).isNull()).alias(f"{kind}{i}") for kind, reader in _READERS.items()]
    return measures


def _narrowest(row, names: Sequence[str]) -> dict[str, str]:
    types = {}
    for i, name in enumerate(names):
        fitting = [kind for kind in _READERS if row[f"{kind}{i}"] == 0]
        types[name] = (fitting[0] if row[f"n{i}"] else "double") if fitting else "string"
    return types


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    columns = []
    for name in df.columns:
        reader = _READERS.get(types.get(name, "string"))
        columns.append(reader(ref(name)).alias(name) if reader and name != ROW_ID else ref(name))
    return df.select(*columns)


def read_csv(spark, path: str | Sequence[str], multiline: bool | None = None, keep_order: bool = True, surplus: str = "refuse") -> DataFrame:
    """Typed CSV table; ``keep_order`` leaves the row id in for order-dependent operators.

    A row with more cells than the header is an error, found by the scan that infers the types; ``surplus='cut'`` leaves such cells out.
    """
    if multiline is None:
        multiline = has_quoted_line_breaks(spark, path)
    raw = read_csv_parts(spark, path, multiline, order=keep_order)
    plain = read_csv_parts(spark, path, multiline, order=False).drop("__path")
    types = infer_types(plain if surplus == "refuse" else plain.drop(SURPLUS), path)
    return apply_types(raw.drop("__path", SURPLUS), types)
