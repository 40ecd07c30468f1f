"""Benchmark items in documents, found by counting shared q-grams in diagonal bands.

Texts are compared in lower case with runs of white space as one blank. An item of m characters leaks
into a document if some region of it is within k edits of the whole item, k being ``error_rate`` of m.
By the q-gram lemma such a region shares at least t = m - q + 1 - k q of the item's q-grams, on
diagonals (place in the document less place in the item) that differ by k at most. So hits are counted
in bands of 2 (k + 1) diagonals that overlap by half, one of which holds them all; bands with t hits are
retained and verified by a banded alignment. Equal hashes of different grams only add hits.

k is lowered to (m - q) / q for short items, so that t is at least 1; an item of fewer than q
characters leaks only into a document whose whole text equals it. Items without characters, or null,
never leak. Null documents are empty. Repeated items (same id and text) count once; every document row
gets its own result rows.

The items' grams go to the tasks as arrays. Their size is bounded: items are dealt into blocks of about
``block_chars`` characters, and every block is searched in all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import gram_hashes, text_bytes

Q = 10
ERROR_RATE = 0.05
BLOCK_CHARS = 4_000_000
_TABLE_BITS = 24
_SLICE = 1 << 20  # characters of a long document looked up at a time


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Items:
    """The grams of a block of items: sorted hashes with their postings (item, place)."""

    ids: list
    texts: list[str]
    q: int
    budgets: np.ndarray
    needed: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    present: np.ndarray
    whole: dict[str, list[int]]

    @classmethod
    def build(cls, rows: list[tuple], error_rate: float = ERROR_RATE, q: int = Q) -> Items:
        ids, texts = [r[0] for r in rows], [normalised(r[1]) for r in rows]
        lengths = np.array([len(t) for t in texts], np.int64)
        budgets = np.maximum(0, np.minimum((lengths * error_rate).astype(np.int64), (lengths - q) // q))
        hashes = [gram_hashes(_points(t), q) for t in texts]
        sizes = [len(h) for h in hashes]
        flat = np.concatenate([*hashes, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(texts)), sizes)
        place = np.concatenate([*(np.arange(s) for s in sizes), np.empty(0, np.int64)]).astype(np.int64)
        order = np.lexsort((place, owner, flat))
        unique, first = np.unique(flat[order], return_index=True)
        present = np.zeros(1 << _TABLE_BITS, bool)
        present[(unique >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        whole: dict[str, list[int]] = {}
        for i, text in enumerate(texts):
            if 0 < len(text) < q:
                whole.setdefault(text, []).append(i)
        return cls(ids, texts, q, budgets, lengths - q + 1 - budgets * q, lengths, unique, np.append(first, len(flat)), owner[order], place[order], present, whole)

    def _hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and diagonals of all shared grams."""
        items, diagonals = [], []
        for at in range(0, len(points), _SLICE):
            hashes = gram_hashes(points[at : at + _SLICE + self.q - 1], self.q)
            maybe = np.flatnonzero(self.present[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            known = self.hashes[slot] == hashes[maybe]
            maybe, slot = maybe[known], slot[known]
            counts = self.first[slot + 1] - self.first[slot]
            posting = np.repeat(self.first[slot] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            items.append(self.owner[posting])
            diagonals.append(np.repeat(maybe + at, counts) - self.place[posting])
        return np.concatenate(items), np.concatenate(diagonals)

    def bands(self, points: np.ndarray) -> list[tuple[int, int]]:
        """(item, band) whose hits reach the bound; band b holds the diagonals from b (k + 1) on, 2 (k + 1) of them."""
        if len(points) < self.q or not len(self.hashes):
            return []
        item, diagonal = self._hits(points)
        if not len(item):
            return []
        # most documents share a few grams with many items: only items with enough hits in all go on
        enough = np.bincount(item, minlength=len(self.texts)) >= np.maximum(self.needed, 1)
        item, diagonal = item[enough[item]], diagonal[enough[item]]
        band = diagonal // (self.budgets[item] + 1)
        keys, counts = np.unique(np.concatenate([np.column_stack([item, band]), np.column_stack([item, band - 1])]), axis=0, return_counts=True) if len(item) else (np.empty((0, 2), np.int64), np.empty(0))
        kept = keys[counts >= self.needed[keys[:, 0]]]
        return [(int(i), int(b)) for i, b in kept]

    def find(self, text: str) -> dict[int, int]:
        """Items that leak into a text, with the least number of edits."""
        text = normalised(text)
        points, found = _points(text), {}
        for item, band in self.bands(points):
            k = int(self.budgets[item])
            low = band * (k + 1)
            edits = banded_edits(self.texts[item], text, low - k, low + 2 * (k + 1) - 1 + k, k)
            if edits <= k:
                found[item] = min(edits, found.get(item, edits))
        for item in self.whole.get(text, ()):
            found[item] = 0
        return found


def banded_edits(pattern: str, text: str, low: int, high: int, most: int) -> int:
    """Least edits of the whole pattern against a region of the text, over the diagonals from low to high; most + 1 if more."""
    start, stop = max(0, low), min(len(text), high + len(pattern))
    if text.find(pattern, start, stop) >= 0:
        return 0
    p, t = _points(pattern), _points(text[start:stop]).astype(np.int64)
    width = high - low + 1
    padded = np.concatenate([np.full(max(0, start - low), -1), t, np.full(width + len(p) + 1, -1)])
    # cell d of row i: the first i pattern characters against text that ends on diagonal low + d
    inside = lambda i: (low + np.arange(width) + i >= start) & (low + np.arange(width) + i <= stop)
    far, ramp = most + 1, np.arange(width)
    row = np.where(inside(0), 0, far)
    for i in range(1, len(p) + 1):
        step = row + (padded[i - 1 : i - 1 + width] != p[i - 1])
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        step = np.minimum.accumulate(step - ramp) + ramp
        row = np.where(inside(i), np.minimum(step, far), far)
        if row.min() > most:
            return far
    return int(row.min())


def item_blocks(benchmark: DataFrame, id_column: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS, error_rate: float = ERROR_RATE, q: int = Q) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, one at a time."""
    items = benchmark.select(F.col(id_column).alias("item_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(blocks)) == block)
        yield Items.build(sorted(((r.item_id, r.text) for r in part.collect()), key=repr), error_rate, q)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", **options) -> DataFrame:
    """(doc_id, item_id, edits): every leak of an item into a document row."""
    doc_type, item_type = (df.schema[c].dataType.simpleString() for df, c in ((docs, id_column), (benchmark, item_column)))
    found = None
    for items in item_blocks(benchmark, item_column, **options):
        part = docs.select(F.col(id_column).alias("doc_id"), text_bytes(text).alias("data")).mapInArrow(_search(items), f"doc_id {doc_type}, item_id {item_type}, edits int")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {doc_type}, item_id {item_type}, edits int")
    return found


def _search(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, leaks = [], []
            for at, value in enumerate(batch.column("data")):
                for item, edits in sorted(items.find(value.as_py().decode("utf-8", "replace")).items()):
                    rows.append(at)
                    leaks.append((items.ids[item], edits))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array([i for i, _ in leaks], pa.int64() if all(isinstance(i, int | None) for i, _ in leaks) else pa.string()), pa.array([e for _, e in leaks], pa.int32())], names=["doc_id", "item_id", "edits"])

    return run


def leaks_column(items: Items, text: str = "text") -> Column:
    """Whether some item of the block leaks into a text."""

    def leaks(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(items.find(bytes(t).decode("utf-8", "replace"))) for t in texts], dtype=bool)

    return F.pandas_udf(leaks, T.BooleanType())(text_bytes(text))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows into which no benchmark item leaks, columns as given."""
    for items in item_blocks(benchmark, **options):
        docs = docs.where(~leaks_column(items, text))
    return docs
