"""Landing-file screening: extension, size and leading bytes of many files as one job."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, functions as F

from ..functions.frames import small_table
from ..functions.text import base_name, display_name, extension
from .csv_source import file_path

# Accepted types, the size limit and file signatures.
ACCEPTED = (".csv", ".xlsx", ".xls")
MAX_BYTES = 26_214_400
XLSX_MAGIC = "504B0304"
XLS_MAGIC = "D0CF11E0A1B11AE1"
WINDOWS_MAGIC = "4D5A"
ELF_MAGIC = "7F454C46"
MACHO_MAGICS = ("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE")
HEAD_BYTES = 8


def _head_of(spark, path: str) -> bytes:
    """The leading bytes of one file, the only ones that are read."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        read = [stream.read() for _ in range(HEAD_BYTES)]
    finally:
        stream.close()
    return bytes(b for b in read if b >= 0)


def file_headers(spark, paths: list[str]) -> dict[str, str]:
    """First line of each file, from one scan; an empty file has none."""
    if not paths:
        return {}
    lines = spark.read.text(paths).select(file_path().alias("path"), "value", F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    first = lines.where("start = 0").groupBy("path").agg(F.min_by("value", "at").alias("header"))
    return {row["path"]: row["header"] for row in first.collect()}


def read_landing(spark, path: str, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """(path, length, head) of the files below a folder.

    Contents are opened only for files small enough to be accepted; the length filter is applied
    by the reader before it opens a file. Larger files are listed without a head. Of accepted files
    over MAX_BYTES, in number those that are ingested one by one, only the leading bytes are read;
    without ``max_bytes`` these may be of any size. Spark's scans pass over empty files, so these
    are taken from the scan's own file listing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.substring("content", 1, HEAD_BYTES)
    whole = MAX_BYTES if max_bytes is None else min(max_bytes, MAX_BYTES)
    small = files.where(F.col("length") <= whole).select("path", "length", head.alias("head"))
    opened = (F.col("length") > whole) & (F.lit(True) if max_bytes is None else F.col("length") <= max_bytes) & extension(base_name(F.col("path"))).isin(*ACCEPTED)
    large = files.where((F.col("length") > whole) & ~opened).select("path", "length", F.lit(None).cast("binary").alias("head"))
    if max_bytes is None or max_bytes > whole:
        heads = [(r["path"], r["length"], _head_of(spark, r["path"])) for r in files.where(opened).select("path", "length").collect()]
        large = large.unionByName(small_table(spark, heads, "path string, length bigint, head binary"))
    listed = [(unquote(name).replace("file:///", "file:/", 1),) for name in files.inputFiles()]
    unread = small_table(spark, listed, "path string").join(files.select("path"), "path", "left_anti")
    empty = unread.select("path", F.lit(0).cast("bigint").alias("length"), F.lit(b"").alias("head"))
    return small.unionByName(large).unionByName(empty)


def screen_files(files: DataFrame, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """Verdict per file: (path, file_name, dataset_name, accepted, reason); without ``max_bytes`` any size will do."""
    named = files.withColumn("file_name", base_name(F.col("path")))
    ext = extension(F.col("file_name"))
    head = F.hex("head")
    over = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    reason = (
        F.when(over, "too large")
        .when(~ext.isin(*ACCEPTED), "unsupported type")
        .when(F.col("length") == 0, "empty")
        .when((ext == ".xlsx") & ~head.startswith(XLSX_MAGIC), "not an xlsx container")
        .when((ext == ".xls") & ~head.startswith(XLS_MAGIC), "not an xls container")
        .when((ext == ".csv") & head.startswith(WINDOWS_MAGIC), "windows executable")
        .when((ext == ".csv") & head.startswith(ELF_MAGIC), "elf executable")
        .when((ext == ".csv") & F.substring(head, 1, 8).isin(*MACHO_MAGICS), "mach-o executable")
    )
    return named.select("path", "file_name", display_name(F.col("file_name")).alias("dataset_name"), "length", reason.isNull().alias("accepted"), reason.alias("reason"))
