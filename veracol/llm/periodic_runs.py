"""Periodic runs of words: stretches that repeat a block of q words four times or more.

Words are parted at ASCII blanks. A run is a stretch of consecutive words with smallest period q (words
q apart are identical), at least ``max(LEAST_WORDS, POWER * q)`` words long, that no neighbouring word
extends with that period.

* Recursive frequency splitting: every word of a run occurs at least ``POWER`` times in it. A word that
  occurs less often within its segment can be in no run of that segment, so it splits the segment;
  the parts are counted anew until none splits. Segments of fewer than ``LEAST_WORDS`` words go.
  All segments of a batch of documents are counted in one sort a round.
* Lag scan of what survives, lags in ascending order. A run of period q holds three whole blocks between
  neighbouring multiples of q, and these blocks are equal. Prefix sums of word hashes compare the blocks of
  one lag at once (m / q comparisons, so m log m for all lags); equal blocks are only a
  candidate, which the words themselves confirm. Candidates inside a run whose period divides q are that run.

``find_runs`` returns a row for each row of the input: the id, the runs in order of start and period, and the text
without what runs repeat (the first q words of a run stay, others that any run covers go, kept words are joined by
one space). Texts are read whole; a document is one row and thus one task's work, in time about proportional to
its words. Null and empty texts, and texts of blanks, have no runs and an empty collapsed text.
Repeated rows and null ids each keep a row of their own. Ties cannot occur: a start and a period name one run.
An empty table gives no rows. Only the named id and text columns are read, so other columns, whatever
their names, take no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import text_bytes

LEAST_WORDS = 6
POWER = 4
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def split_rare(words: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the stretches of words that survive splitting; ``segment`` names each word's document."""
    place = np.arange(len(words))
    starts, stops = [], []
    width = np.int64(words.max(initial=0)) + 1
    while len(place):
        # one sort counts the words of all open segments
        _, inverse, count = np.unique(segment * width + words[place], return_inverse=True, return_counts=True)
        often = count[inverse] >= POWER
        split = np.zeros(segment[-1] + 1, bool)
        split[segment[~often]] = True
        stable = ~split[segment]
        done = place[stable]
        first = np.flatnonzero(np.diff(segment[stable], prepend=-1))
        starts.append(done[first])
        stops.append(done[np.append(first[1:], len(done))[: len(first)] - 1] + 1)
        place, segment = place[often & ~stable], segment[often & ~stable]
        if not len(place):
            break
        new = np.empty(len(place), bool)
        new[0] = True
        new[1:] = (place[1:] != place[:-1] + 1) | (segment[1:] != segment[:-1])
        segment = np.cumsum(new) - 1
        long_enough = (np.bincount(segment) >= LEAST_WORDS)[segment]
        place, segment = place[long_enough], segment[long_enough]
        if len(segment):
            segment = np.cumsum(np.diff(segment, prepend=segment[0]) != 0)
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts, stops = np.concatenate(starts), np.concatenate(stops)
    order = np.argsort(starts)
    order = order[stops[order] - starts[order] >= LEAST_WORDS]
    return starts[order], stops[order]


def _stretches(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False]))))
    return zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)


def lag_scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of one segment of word numbers."""
    n = len(words)
    hashes = (words.astype(np.uint64) + np.uint64(1)) * _BASE
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    with np.errstate(over="ignore"):
        powers = np.full(n + 1, _BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(hashes * powers[:-1])))
    runs: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    for q in range(1, n // POWER + 1):
        with np.errstate(over="ignore"):
            block = np.diff(sums[::q])
            same = block[1:] == block[:-1] * powers[q]
        cube = same[1:] & same[:-1] if POWER > 3 else same
        if not cube.any():
            continue
        for j, k in _stretches(cube):
            # blocks j to k+1 are equal: every q-periodic stretch of three blocks among them lies in [low, high)
            inner, outer = j * q, (k + 2) * q
            if any(q % p == 0 and s <= inner and outer <= s + length for s, length, p in runs):
                continue
            low, high = max(0, inner - q), min(n, outer + q)
            for a, b in _stretches(words[low : high - q] == words[low + q : high]):
                start, length = low + a, b - a + q
                if length >= max(LEAST_WORDS, POWER * q) and (start, length) not in known:
                    known.add((start, length))
                    runs.append((start, length, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[bytes | None]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text its runs and the text without what they repeat."""
    split = [(t or b"").split() for t in texts]
    ids: dict[bytes, int] = {}
    total = sum(map(len, split))
    words = np.fromiter((ids.setdefault(w, len(ids)) for w in itertools.chain.from_iterable(split)), np.int64, total)
    sizes = np.array([len(s) for s in split], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    starts, stops = split_rare(words, np.repeat(np.arange(len(split)), sizes))
    owner = np.searchsorted(offsets, starts, side="right") - 1
    segments: dict[int, list[tuple[int, int]]] = {}
    for doc, a, b in zip(owner.tolist(), starts.tolist(), stops.tolist(), strict=True):
        segments.setdefault(doc, []).append((a, b))
    for doc, doc_words in enumerate(split):
        base = int(offsets[doc])
        runs = [(a - base + s, length, q) for a, b in segments.get(doc, ()) for s, length, q in lag_scan(words[a:b])]
        if runs:
            gone = np.zeros(len(doc_words) + 1, np.int64)
            for s, length, q in runs:
                gone[s + q] += 1
                gone[s + length] -= 1
            doc_words = [w for w, g in zip(doc_words, np.cumsum(gone).tolist(), strict=False) if not g]
        yield runs, b" ".join(doc_words)


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs, collapsed) of every row."""
    rows = docs.select(F.col(key), text_bytes(text).alias("__bytes"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, kept = [], []
            for found, collapsed in runs_of_texts(batch.column(1).to_pylist()):
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                kept.append(collapsed.decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, _RUN_TYPE), pa.array(kept, pa.string())], [key, "runs", "collapsed"])

    schema = T.StructType([rows.schema[0], T.StructField("runs", T._parse_datatype_string(f"array<{_RUN}>")), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(scan, schema)


def main_run(runs: Column) -> Column:
    """The run with the greatest length, the smallest start and then period among equals; null without runs."""
    keyed = F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.try_element_at(F.array_sort(keyed), F.lit(1))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Runs as counts, the main run and SHA-256 digests of all runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    rows = found.select(key, F.size("runs").cast("bigint").alias("n_runs"), main_run(F.col("runs")).alias("main"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select(key, "n_runs", "main.start", "main.length", "main.period", F.expr("main.length * 1000 div main.period").cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents of which about a tenth turn periodic at a place that their id decides.

    With h = crc32 of the decimal id and g = h div 10: if h % 10 = 0, each word from a = g % n on becomes the
    word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8), of the n words. Other rows, null ids included, stay.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select(key, text, F.when(h % 10 == 0, words).alias("__w"), F.expr(f"crc32(cast(cast(`{key}` as string) as binary)) div 10").alias("__g"))
    rows = rows.withColumn("__a", F.when(F.size("__w") > 0, F.col("__g") % F.size("__w")))
    rows = rows.withColumn("__p", F.expr("1 + (size(__w) - __a) div (3 + __g % 8)"))
    planted = F.expr("array_join(transform(__w, (w, i) -> if(i < __a, w, __w[cast(__a + (i - __a) % __p as int)])), ' ')")
    return rows.select(key, F.when(F.col("__a").isNotNull(), planted).otherwise(F.col(text)).alias(text))
