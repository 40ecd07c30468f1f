"""Exact order statistics of many columns by refining histograms.

All columns are searched at once. A first grouping by column finds counts and ends; then every interval that holds a
wanted rank is cut into ``BUCKETS`` buckets, and one ``groupBy(search, bucket)`` counts them, with the least and the
greatest value of each. The bucket that holds a rank is the next interval, until its two ends are one value. Buckets are combined
before they move and may go to any number of reducers; what comes back is one row for each wanted rank. The number of jobs does
not depend on the number of columns or ranks, and a value repeated any number of times is one end of some bucket.

An interval is cut evenly. If that hardly separated its values, it is cut at zero next, or by orders of magnitude if it lies on
one side of zero. Every cut is a monotone function of the value, so ranks stay exact whatever the rounding of the cut.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import cell, chunks, field_map
from ..session import cut_lineage

BUCKETS = 4096
SEARCHES_PER_SCAN = 30  # elements of one generated row; further searches are another branch of the same job
POOR = 0.25  # an even cut that leaves this share in the bucket is followed by one of another kind


@dataclass
class _Search:
    """An interval [low, high] of a column, the number of values before it, and the ranks wanted inside."""

    column: str
    low: float
    high: float
    skipped: int = 0
    evenly: bool = True
    ranks: list[int] = field(default_factory=list)

    def bucket(self, value: Column, buckets: int) -> Column:
        return _bucket(value, F.lit(self.low), F.lit(self.high), F.lit(self.evenly), buckets)


def _bucket(value: Column, low: Column, high: Column, evenly: Column, buckets: int) -> Column:
    """Number of the bucket of a value in [low, high], low < high; null outside of the interval."""
    inf = F.lit(math.inf)
    logs = lambda x, a, b: F.floor((F.log2(x) - F.log2(a)) / (F.log2(b) - F.log2(a)) * buckets)
    number = (
        F.when((low == -inf) | (high == inf), F.when(value == inf, 1).when(value == -inf, -1).otherwise(0))  # infinities are buckets of their own
        .when((low < 0) & (high > 0) & (~evenly | (high - low == inf)), F.signum(value))
        .when(~evenly & (low > 0) & (high > 2 * low), logs(value, low, high))
        .when(~evenly & (high < 0) & (low < 2 * high), -logs(-value, -high, -low))
        .otherwise(F.floor((value - low) / (high - low) * buckets))
    )
    return F.when((value >= low) & (value <= high), number.cast("int"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], counts: Mapping[str, int] | None = None, buckets: int = BUCKETS) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per column; ``counts`` of known columns without values spare their search."""
    fields = field_map(df)
    doubles = {name: cell(fields[name]).cast("double") for name in dict.fromkeys(columns) if counts is None or counts[name]}
    totals, open_searches = _ends(df, doubles, probabilities)
    values: dict[tuple[str, int], float] = {}
    while open_searches:
        for s in [s for s in open_searches if s.low == s.high]:
            values |= {(s.column, rank): s.low for rank in s.ranks}
        open_searches = _narrow(df, doubles, [s for s in open_searches if s.low != s.high], buckets)
    found = {name: [_between(values, name, totals[name], p) if totals.get(name) else None for p in probabilities] for name in columns}
    return {name: [finite_or_none(value) for value in row] for name, row in found.items()}


def _ends(df: DataFrame, doubles: Mapping[str, Column], probabilities: Sequence[float]) -> tuple[dict[str, int], list[_Search]]:
    """Counts of all columns, and the first interval of each with its wanted ranks."""
    names = list(doubles)
    totals, searches = {}, []
    for row in _grouped(df, [(F.lit(0), doubles[name]) for name in names]).select("s", "n", "low", "high").collect() if names else []:
        name = names[row["s"]]
        totals[name] = row["n"]
        ranks = sorted({r for p in probabilities for r in _rank_pair(row["n"], p)})
        searches.append(_Search(name, row["low"], row["high"], ranks=ranks))
    return totals, searches


def _grouped(df: DataFrame, searches: Sequence[tuple[Column, Column]]) -> DataFrame:
    """(s, bucket, n, low, high) of the values of each search (bucket, value); values without a bucket do not count."""
    branches = []
    for part in chunks(list(enumerate(searches)), SEARCHES_PER_SCAN):
        cells = [F.struct(F.lit(i).alias("s"), bucket.alias("bucket"), value.alias("v")) for i, (bucket, value) in part]
        branches.append(df.select(F.inline(F.array(*cells))).where("bucket IS NOT NULL AND v IS NOT NULL"))
    rows = reduce(DataFrame.unionByName, branches)
    return rows.groupBy("s", "bucket").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def _narrow(df: DataFrame, doubles: Mapping[str, Column], searches: Sequence[_Search], buckets: int) -> list[_Search]:
    """The buckets that hold the wanted ranks, as the searches of the next round."""
    if not searches:
        return []
    counted = _grouped(df, [(s.bucket(doubles[s.column], buckets), doubles[s.column]) for s in searches])
    order = Window.partitionBy("s").orderBy("bucket")  # at most BUCKETS rows and a few
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("n").over(Window.partitionBy("s"))
    wanted = F.create_map(*[F.lit(x) for i, s in enumerate(searches) for x in (i, [r - s.skipped for r in s.ranks])])
    held = F.exists(F.try_element_at(wanted, F.col("s")), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
    rows = counted.withColumns({"before": before, "inside": inside}).where(held).collect()
    following = []
    for row in rows:
        s = searches[row["s"]]
        first = s.skipped + row["before"]
        ranks = [r for r in s.ranks if first <= r < first + row["n"]]
        following.append(_Search(s.column, row["low"], row["high"], first, not (s.evenly and row["n"] > POOR * row["inside"]), ranks))
    return following


def _rank_pair(count: int, probability: float) -> tuple[int, int]:
    lower = math.floor((count - 1) * probability)
    return lower, min(lower + 1, count - 1)


def _between(values: Mapping[tuple[str, int], float], name: str, count: int, probability: float) -> float:
    lower, upper = _rank_pair(count, probability)
    return _mix(values[name, lower], values[name, upper], (count - 1) * probability - lower)


def _mix(low: float, high: float, share: float) -> float:
    """Linear interpolation; equal or exact ranks need no arithmetic, which infinities would break."""
    return low if share == 0.0 or low == high else low + (high - low) * share


def finite_or_none(value: float | None) -> float | None:
    return None if value is None or math.isnan(value) else value


def grouped_quantiles(values: DataFrame, keys: Sequence[str], probabilities: Sequence[float], buckets: int = BUCKETS) -> DataFrame:
    """(keys, n, quantiles) for rows (keys, v): the same search for every group of keys at once.

    Groups may be any number and of any size: intervals are a table, one row for each wanted rank, and no job is one group's.
    Groups without values and those with a null key have no row; a quantile that is not a number is null.
    """
    keys = list(keys)
    values = values.select(*keys, F.col("v").cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    ends = values.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = [((F.col("n") - 1) * F.lit(p)) for p in probabilities]
    lower = [F.floor(x).cast("bigint") for x in place]
    ranks = F.array_distinct(F.array(*lower, *[F.least(x + 1, F.col("n") - 1) for x in lower]))
    found = cut_lineage(ends.select(*keys, "n", "low", "high", F.lit(0).cast("bigint").alias("skipped"), F.lit(True).alias("evenly"), F.explode(ranks).alias("rank")))
    sizes = found.select(*keys, "n").distinct()
    done, searching = [], found
    cut = ["low", "high", "skipped", "evenly"]
    while True:
        done.append(searching.where("low = high").select(*keys, "rank", F.col("low").alias("value")))
        searching = searching.where("low < high")
        if searching.isEmpty():
            break
        intervals = searching.groupBy(*keys, *cut).agg(F.collect_set("rank").alias("ranks"))  # at most twice the probabilities
        inside = values.join(intervals, keys).withColumn("bucket", _bucket(F.col("v"), F.col("low"), F.col("high"), F.col("evenly"), buckets)).where("bucket IS NOT NULL")
        counted = inside.groupBy(*keys, *cut, "ranks", "bucket").agg(F.count("v").alias("m"), F.min("v").alias("a"), F.max("v").alias("b"))
        whole = Window.partitionBy(*keys, *cut)
        before = F.sum("m").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m") + F.col("skipped")
        counted = counted.withColumns({"before": before, "inside": F.sum("m").over(whole)})
        held = F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("m")))
        following = counted.select(*keys, F.col("a").alias("low"), F.col("b").alias("high"), F.col("before").alias("skipped"), (~(F.col("evenly") & (F.col("m") > POOR * F.col("inside")))).alias("evenly"), F.explode(held).alias("rank"))
        searching = cut_lineage(following)
    at = reduce(DataFrame.unionByName, done).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))

    def quantile(x: Column, low: Column) -> Column:
        first, second = F.col("at")[low], F.col("at")[F.least(low + 1, F.col("n") - 1)]
        mixed = F.when((x == low) | (first == second), first).otherwise(first + (second - first) * (x - low))
        return F.when(~F.isnan(mixed), mixed)

    return sizes.join(at, keys).select(*keys, "n", F.array(*[quantile(x, low) for x, low in zip(place, lower, strict=True)]).alias("quantiles"))
