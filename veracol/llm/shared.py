"""What several of these operators need: tables, batches, written stages and components of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veracol.session import cut_lineage

# Bytes of one Arrow batch: long documents come in batches of bounded size.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; batches handed to Python hold about BATCH_BYTES at most from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b"").cast("binary"))


def arrow_rows(schema: pa.Schema, batches: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Record batches of a fixed schema from dictionaries of arrays; empty ones are left out."""
    for columns in batches:
        if len(columns[schema.names[0]]):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def sorted_groups(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of a key together in one task, in order, for a pass that reads them as a stream."""
    return df.repartition(F.col(key)).sortWithinPartitions(key, *order)


_BASE = 0x9E3779B97F4A7C15


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hashes of all q-grams, scrambled, put together from those of powers of two."""
    n = len(points) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, width, base = points.astype(np.uint64) + np.uint64(1), 1, np.uint64(_BASE)
    total, covered, scale = None, 0, None
    with np.errstate(over="ignore"):
        while True:
            if q & width:
                piece = power[covered : covered + n]
                total = piece.copy() if total is None else total * base + piece
                covered += width
            if covered == q:
                break
            power = power[: len(power) - width] * base + power[width:]
            width, base = 2 * width, base * base
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(32)
    return total


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared scratch folder and read back."""
    return cut_lineage(df)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links (a, b): a row (node, root) for each linked node but the roots.

    Alternating large-star and small-star rounds: every node hands its larger, then its smaller
    neighbours to the smallest it knows, until each points at the smallest node of its component.
    Minima are combined before the shuffle; the only joins are on a node's own id, and a node
    with very many neighbours is an inner join that adaptive execution can split.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct())
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        lowest = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")).withColumnRenamed("v", "u")
        large = edges.join(lowest, "u").select("v", F.col("m").alias("u")).where("v <> u").distinct()
        # large holds (node, smaller node); small-star hangs each node's smaller neighbours on the least of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
        edges = cut(small.unionByName(least.select("v", F.col("m").alias("u"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no convergence after {max_rounds} rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64, copy=False).view(np.int64)


class Joined:
    """Which items this task has already joined, so that many shared keys give one link."""

    def __init__(self, most: int = 200_000):
        self.parent: dict[int, int] = {}
        self.most = most

    def find(self, x: int) -> int:
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    def new(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if len(self.parent) > self.most:
            self.parent.clear()
        self.parent[b] = a
        return True
