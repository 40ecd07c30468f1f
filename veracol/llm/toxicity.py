"""Toxicity scores learned from confirmed toxic examples and unlabelled text.

The model is linear in a text's different words: each adds the weights of its own hash bucket and of
its beginnings' (insults come in inflected forms). It is trained with the non-negative
positive-unlabelled risk: with the share ``prior`` of toxic texts,

    risk = prior * mean loss(+f on toxic) + max(0, mean loss(-f on unlabelled) - prior * mean loss(-f on toxic)).

The bracket estimates the risk on clean texts without a clean example; where it falls below zero
the model has begun to learn the unlabelled toxic texts by heart, and the step climbs instead. An L1
term keeps words that say nothing at exactly zero, so that long texts are not judged by the sum of
many small errors. A final scale and offset are fitted so that the score is a probability.

Bounds, all parameters of ``fit``: at most ``most_toxic`` toxic, ``most_unlabelled`` unlabelled and
``most_labelled`` labelled rows for the scale, each the rows with the smallest hashes of their ids
among those that may be used. Every row is scored. Null and empty texts score by the offset alone.
Labels of rows whose crc32(id) mod 3 is 1 are held out and never read; a null id is not held out and has no
label. Of repeated labels of one id the largest counts; null labels do not count. Without toxic
examples every score is the prior, 0 if there are no labels at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import text_bytes

BITS = 20
PREFIXES = (5, 7)
THRESHOLD = 0.7
_SEPARATE = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_CACHED = 150_000


def words(data: bytes) -> set[bytes]:
    """The different words of a text in lower case."""
    return set(data.decode("utf-8", "replace").lower().encode().translate(_SEPARATE).split())


def buckets(word: bytes) -> list[int]:
    """Hash buckets of a word and of its first bytes."""
    parts = [word] + [b"^" + word[:n] for n in PREFIXES if len(word) > n]
    return [zlib.crc32(part) & ((1 << BITS) - 1) for part in parts]


def held_out(id_column: str = "doc_id") -> Column:
    """Rows kept for judging the model: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Weights of word buckets, an offset, and the scale and shift that make a probability."""

    buckets: np.ndarray
    weights: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0

    def column(self, text: str = "text") -> Column:
        """The score of a text column, 0 to 1."""
        known = dict(zip(self.buckets.tolist(), self.weights.tolist(), strict=True))
        offset, scale, shift = self.offset, self.scale, self.shift

        class Weights(dict):
            def __missing__(self, word):
                if len(self) > _CACHED:
                    self.clear()
                weight = self[word] = sum(known.get(b, 0.0) for b in buckets(word))
                return weight

        seen = Weights()

        def score(texts: pd.Series) -> pd.Series:
            # sorted, so that a score never depends on the order of a set
            sums = np.array([sum(sorted(filter(None, map(seen.__getitem__, words(bytes(t)))))) for t in texts], dtype=float)
            return pd.Series(1 / (1 + np.exp(-np.clip(scale * (sums + offset) + shift, -40, 40))))

        return F.pandas_udf(score, T.DoubleType())(text_bytes(text))


@dataclass
class _Sample:
    """Sparse rows of counts: row number and column of each entry, repeats adding up."""

    rows: np.ndarray
    columns: np.ndarray
    n: int

    def margins(self, weights: np.ndarray, offset: float) -> np.ndarray:
        return np.bincount(self.rows, weights=weights[self.columns], minlength=self.n) + offset

    def gradient(self, per_row: np.ndarray, n_columns: int) -> np.ndarray:
        return np.bincount(self.columns, weights=per_row[self.rows], minlength=n_columns)


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def nn_pu(positive: _Sample, unlabelled: _Sample, n_columns: int, prior: float, steps: int = 150, rate: float = 0.1, l1: float = 0.0, beta: float = 0.0, gamma: float = 1.0):
    """Weights and offset that minimise the non-negative positive-unlabelled risk (Adam, L1 by soft thresholds)."""
    w, b = np.zeros(n_columns), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_columns + 1), np.zeros(n_columns + 1)
    for step in range(1, steps + 1):
        fp, fu = positive.margins(w, b), unlabelled.margins(w, b)
        clean_risk = _softplus(fu).mean() - prior * _softplus(fp).mean()
        on_unlabelled = _sigmoid(fu) / unlabelled.n
        on_positive = -prior * _sigmoid(fp) / positive.n
        if clean_risk >= -beta:
            gp, gu = on_positive - prior * _sigmoid(-fp) / positive.n, on_unlabelled
        else:
            gp, gu = -gamma * on_positive, -gamma * on_unlabelled
        g = np.append(positive.gradient(gp, n_columns) + unlabelled.gradient(gu, n_columns), gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        threshold = rate * l1 / (np.sqrt(v[:-1] / (1 - 0.999**step)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - threshold, 0)
    return w, b


def _features(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    schema = pa.schema([("kind", pa.int32()), ("buckets", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(sorted(b for w in words(v.as_buffer().to_pybytes()) for b in buckets(w)), dtype="<i4").tobytes() for v in batch.column("data")]
            yield pa.RecordBatch.from_arrays([batch.column("kind").cast(pa.int32()), pa.array(found, pa.binary())], schema=schema)

    return docs.select("kind", text_bytes(text).alias("data")).mapInArrow(run, "kind int, buckets binary")


def _samples(parts: dict[int, list[np.ndarray]], least: int) -> tuple[np.ndarray, list[_Sample]]:
    """Buckets that ``least`` rows have, and each kind's rows over them."""
    everything = [x for rows in parts.values() for x in rows]
    counts = np.zeros(1 << BITS, np.int64)
    for x in everything:
        counts[x] += 1  # a repeat within a row counts once
    kept = np.flatnonzero(counts >= least)
    position = np.full(1 << BITS, -1, np.int32)
    position[kept] = np.arange(len(kept))
    out = []
    for kind in sorted(parts):
        rows = parts[kind]
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        column = position[np.concatenate(rows)] if rows else np.empty(0, np.int32)
        out.append(_Sample(owner[column >= 0], column[column >= 0], max(1, len(rows))))
    return kept, out


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", most_toxic: int = 3000, most_unlabelled: int = 6000, most_labelled: int = 3000, least_rows: int = 3, sparsity: float = 0.1) -> Model:
    """Train on bounded samples of the rows that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column)).groupBy(F.col(id_column).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    shares = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_label"), F.lit(0)).alias("toxic")).first()
    if not shares.toxic:
        prior = 0.0
        return Model(np.empty(0, int), np.empty(0), -40.0)
    prior = min(0.9, max(1e-4, shares.toxic / shares.n))
    mixed = lambda salt: F.xxhash64(F.lit(salt), F.col("_id"))
    first = lambda df, salt, n: df.orderBy(mixed(salt), "_id").limit(n)
    ids = docs.select(F.col(id_column).alias("_id")).where(F.col("_id").isNotNull())
    chosen = (
        first(known.where("_label = 1").select("_id"), "toxic", most_toxic).withColumn("kind", F.lit(0))
        .unionByName(first(ids.join(known, "_id", "left_anti").distinct(), "unlabelled", most_unlabelled).withColumn("kind", F.lit(1)))
        .unionByName(first(known.where("_label = 0").select("_id"), "clean", most_labelled).withColumn("kind", F.lit(2)))
    )
    # ``chosen`` holds at most the three bounds' rows of two numbers: small enough for every executor
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").select("kind", F.col("_text").alias("text"))
    parts: dict[int, list[np.ndarray]] = {0: [], 1: [], 2: []}
    for row in _features(rows, "_id", "text").toLocalIterator():
        parts[row.kind].append(np.frombuffer(row.buckets, dtype="<i4"))
    if not parts[0]:
        return Model(np.empty(0, int), np.empty(0), float(np.log(prior / (1 - prior))))
    if not parts[1]:  # everything is labelled: those texts serve without their labels
        parts[1] = parts[0] + parts[2]
    kept, (toxic, unlabelled, clean) = _samples(parts, least_rows)
    # the noise of a word's gradient falls with the root of the number of examples, and so does the threshold
    l1 = sparsity * prior / np.sqrt(len(parts[0]))
    weights, offset = nn_pu(toxic, unlabelled, len(kept), prior, l1=l1)
    scale, shift = _calibrated(toxic.margins(weights, offset)[: len(parts[0])], clean.margins(weights, offset)[: len(parts[2])], prior)
    used = np.flatnonzero(weights)
    return Model(kept[used], weights[used], offset, scale, shift)


def _calibrated(toxic: np.ndarray, clean: np.ndarray, prior: float) -> tuple[float, float]:
    """Scale and shift of the logistic curve through the margins of labelled rows."""
    if not len(clean):
        return 1.0, 0.0
    x = np.concatenate([toxic, clean])
    y = np.r_[np.ones(len(toxic)), np.zeros(len(clean))]
    each = np.r_[np.full(len(toxic), prior / len(toxic)), np.full(len(clean), (1 - prior) / len(clean))]
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * x + b)
        g = np.array([(each * (p - y) * x).sum() + 1e-4 * (a - 1), (each * (p - y)).sum()])
        h = each * p * (1 - p)
        hessian = np.array([[(h * x * x).sum() + 1e-4, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return max(float(a), 0.05), float(b)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's id, ``held_out``, ``score`` and ``predicted``."""
    scored = docs.select(F.col(id_column), held_out(id_column).alias("held_out"), model.column(text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Rows whose score is below the threshold, columns as given."""
    return docs.where(model.column(text) < THRESHOLD)
