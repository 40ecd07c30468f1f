"""Exact top-k search by distributed histogram selection.

All candidates are scored against all queries, block by block; nothing is approximate. Scores are
integers, so each query's k-th best is found like a digit: a round counts the scores of the query's
current range in ``BINS`` equal bins, sums the counts over all blocks, and narrows the range to the bin
that holds the k-th best. After as many rounds as the widest possible score has digits the range is
one score, the threshold. A last scoring keeps what reaches it; ties go to the smaller id.

* A pair of blocks sends, for each query, only its topmost bins that together hold k scores: if one
  block alone has k scores from a bin on, the k-th best is not below. Likewise the last round sends at
  most k rows for each query and pair. No group of equal scores, however large, is gathered.
* Blocks hold a bounded number of vectors as one binary value. Each candidate block meets each query
  block once, over a join on block numbers; it is the stated query set against all rows.

Vectors are turned into floor(256 * x), x as double. Rows whose vector is null or holds a null or
non-finite component, or whose id is null, take no part. A query meets the vectors of its own length;
all lengths are searched in the same rounds, and vectors without components score 0 with each other. A row never
is its own candidate: rows that share a query's id are left out. Repeated rows with other ids are
candidates of their own; repeated ids count as often as they occur, and ask once, with their smallest vector.
Inner products are exact at any size. One that a long cannot hold is returned as the long nearest to it
(-2^63 as -2^63 + 1); such scores tie. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F

from .shared import cut

SCALE = 256
BINS = 4096
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
_TILE = 128
_LARGE = 1 << 53  # from here on a double is an integer
_END = (1 << 63) - 1
_WIDE = "<f8"


def _components(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, x, n): whole rows only, components as doubles that are multiples of 1 / SCALE, which holds them exactly at any size."""
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = df.select(F.col(id_column).alias("vec_id"), doubles.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad)
    whole = F.transform("x", lambda x: F.when(F.abs(x) < F.lit(float(_LARGE)), F.floor(x * SCALE) / SCALE).otherwise(x))
    return rows.select("vec_id", whole.alias("x"), F.size("x").alias("n"))


def _stored(flat: np.ndarray, code: str) -> bytes:
    return (flat if code == _WIDE else flat * SCALE).astype(code).tobytes()


def _integers(data: bytes, code: str, rows: int, n: int) -> np.ndarray:
    """Stored components as integers, a row for each vector."""
    values = np.frombuffer(data, code)
    if code == _WIDE:
        values = np.array([int(x) * SCALE if abs(x) >= _LARGE else int(x * SCALE) for x in values.tolist()], dtype=object)
    else:
        values = values.astype(np.int64)
    return values.reshape(rows, n)


def _blocks(rows: DataFrame, size: int, code: str) -> DataFrame:
    """Rows of a partition in blocks of up to ``size`` vectors of one length: (block, n, ids, vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        count = 0

        def blocks():
            for n, parts in held.items():
                ids, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int32()), "ids": [ids.tobytes()], "vectors": [_stored(flat, code)]})
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                if count + piece.num_rows > size:
                    yield from blocks()
                    count = 0
                count += piece.num_rows
                lengths = piece.column("n").to_numpy()
                for n in np.unique(lengths).tolist():
                    part = piece.filter(pa.array(lengths == n))
                    held.setdefault(n, []).append((part.column("vec_id").cast(pa.int64()).to_numpy(), part.column("x").flatten().to_numpy()))
        yield from blocks()

    return cut(rows.mapInArrow(run, "n int, ids binary, vectors binary").withColumn("block", F.monotonically_increasing_id()))


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where every partial sum is an exact integer, else in wide integers."""
    largest = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * queries.shape[1]
    if queries.dtype != object and candidates.dtype != object:
        if largest < _LARGE:
            return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
        if largest < _END:
            return queries @ candidates.T
    exact = queries.astype(object) @ candidates.astype(object).T if queries.shape[1] else np.zeros((len(queries), len(candidates)), object)
    return np.clip(exact, -_END, _END).astype(np.int64)


def _code(largest: float) -> str:
    """Array type of components up to a size."""
    return "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8" if largest < 1 << 63 else _WIDE


def _tiles(row, codes: tuple[str, str]):
    """Scores of a pair of blocks, a few queries at a time; a query's own rows are masked out."""
    q_ids, c_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    q, c = _integers(row["q_vectors"], codes[0], len(q_ids), row["n"]), _integers(row["vectors"], codes[1], len(c_ids), row["n"])
    low, width = np.frombuffer(row["q_low"], np.int64), np.frombuffer(row["q_width"], np.int64)
    for at in range(0, len(q_ids), _TILE):
        part = slice(at, at + _TILE)
        yield q_ids[part], low[part], width[part], c_ids, _scores(q[part], c), q_ids[part, None] != c_ids[None, :]


def _histograms(k: int, codes: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for q_ids, low, width, _, scores, other in _tiles(row, codes):
                    n = len(q_ids)
                    # bin BINS gathers what lies above the range: it is known to be fewer than k
                    # differences may need all 64 bits
                    beyond = (scores.view(np.uint64) - low.astype(np.uint64)[:, None]) // np.maximum(width, 1).astype(np.uint64)[:, None]
                    bins = np.where(other & (scores >= low[:, None]), np.minimum(beyond, np.uint64(BINS)).astype(np.int64), -1)
                    counts = np.bincount((bins + 1 + (BINS + 2) * np.arange(n)[:, None]).ravel(), minlength=n * (BINS + 2)).reshape(n, -1)[:, 1:]
                    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
                    query, bin_ = np.nonzero((counts > 0) & (above < k))
                    yield pa.RecordBatch.from_pydict({"query_id": q_ids[query], "bin": bin_.astype(np.int64), "n": counts[query, bin_].astype(np.int64)})

    return run


def _winners(k: int, codes: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for q_ids, low, _, c_ids, scores, other in _tiles(row, codes):
                    query, candidate = np.nonzero(other & (scores >= low[:, None]))
                    score = scores[query, candidate]
                    order = np.lexsort((c_ids[candidate], -score, query))
                    query, candidate, score = query[order], candidate[order], score[order]
                    starts = np.searchsorted(query, np.arange(len(q_ids)))
                    best = np.arange(len(query)) - starts[query] < k
                    yield pa.RecordBatch.from_pydict({"query_id": q_ids[query[best]], "vec_id": c_ids[candidate[best]], "score": score[best]})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k best rows of ``vectors``: (query_id, rank, vec_id, score)."""
    rows, asked = _components(vectors, id_column, vector), _components(queries, id_column, vector)
    largest = lambda df: df.agg(F.max(F.array_max(F.transform("x", F.abs))), F.max("n")).first()
    (most_asked, n), (most, _) = largest(asked), largest(rows)
    sizes = [SCALE * int(x or 0) + SCALE for x in (most_asked, most)]
    codes = _code(sizes[0]), _code(sizes[1])
    bound = min(sizes[0] * sizes[1] * (n or 0) + 1, _END)
    candidates = _blocks(rows, CANDIDATE_BLOCK, codes[1])
    # one row for each query id: a repeated id is the same question
    asked = cut(asked.groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("n", F.size("x")))
    # every query starts with the whole possible range
    state = cut(asked.select(F.col("vec_id").alias("query_id"), F.lit(-bound).cast("bigint").alias("low"), F.lit(-(-2 * bound // BINS)).cast("bigint").alias("width")))
    while True:
        pairs = _pairs(asked, state, candidates, codes[0])
        if state.agg(F.max("width")).first()[0] in (None, 0):
            break
        counts = pairs.mapInArrow(_histograms(k, codes), "query_id bigint, bin bigint, n bigint").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bin")))
        reached = counts.withColumn("upto", above).where(F.col("upto") >= k).groupBy("query_id").agg(F.max("bin").alias("bin"))
        # fewer than k scores in all: everything from the lowest bin on counts
        wide = lambda c: c.cast("decimal(20,0)")
        low = (wide(F.col("low")) + wide(F.coalesce("bin", F.lit(0))) * wide(F.col("width"))).cast("bigint")
        narrowed = state.join(reached, "query_id", "left").withColumn("low", low)
        width = F.when((F.col("width") == 1) | F.col("bin").isNull(), 0).otherwise(F.expr(f"(width + {BINS - 1}L) div {BINS}L"))
        state = cut(narrowed.select("query_id", "low", width.cast("bigint").alias("width")))
    found = pairs.mapInArrow(_winners(k, codes), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pairs(asked: DataFrame, state: DataFrame, candidates: DataFrame, code: str) -> DataFrame:
    """Every pair of a query block with its current ranges and a candidate block, each pair in some task."""
    numbered = asked.withColumnRenamed("vec_id", "query_id").join(state, "query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def blocks():
            rows = pa.Table.from_batches(held)
            for n in np.unique(rows.column("n").to_numpy()).tolist():
                part = rows.filter(pa.compute.equal(rows.column("n"), n)).combine_chunks()
                column = lambda name: part.column(name).to_numpy().astype(np.int64).tobytes()
                flat = np.concatenate([x.flatten().to_numpy() for x in part.column("x").chunks])
                yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int32()), "q_ids": [column("query_id")], "q_low": [column("low")], "q_width": [column("width")], "q_vectors": [_stored(flat, code)]})

        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                if held and sum(r.num_rows for r in held) + part.num_rows > QUERY_BLOCK:
                    yield from blocks()
                    held = []
                held.append(part)
        if held:
            yield from blocks()

    blocks = numbered.select("query_id", "low", "width", "x", "n").mapInArrow(run, "n int, q_ids binary, q_low binary, q_width binary, q_vectors binary")
    # each query block is dealt to every slot of candidate blocks; blocks of one length meet
    slots = max(1, candidates.count())
    sent = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return sent.join(candidates.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int")), ["slot", "n"]).repartition(F.col("slot"), F.xxhash64("q_ids"))
