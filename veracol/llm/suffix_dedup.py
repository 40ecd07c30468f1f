"""Removal of bytes that long repeated strings cover, by merging Burrows-Wheeler transforms.

A byte goes if some string of ``LENGTH`` bytes covers it that also starts elsewhere, in the same or
another document. The strings are judged on the whole input.

1. Meeting places. Every window of LENGTH bytes is named by the least hash of its ``GRAM``-byte grams;
   equal windows have equal names. Neighbouring windows of one name are a run. Runs are counted by
   name and by the digest of their bytes: a run whose bytes occur twice consists of repeated windows,
   and a name with one run, at one place, has none. What is left is names that runs of different bytes share.
2. Transforms. One representative of each such run is dealt by name. A task turns what it gets
   into shards, and sorts each shard's suffixes to LENGTH bytes. The alphabet is blocks of ``BLOCK``
   bytes: a segment is read as BLOCK interleaved strings, so suffixes at every byte are there, and a
   transform holds, for each suffix in order, the block before it. Strings with a block that occurs
   once among all a task compares cannot repeat; bytes that only they cover are left out.
3. Merging. The shards' transforms are merged from the blocks alone, without sorting the suffixes
   anew: beginning with one shard after the other, a round sends each entry, in the present order, to
   the bucket of its block, which orders the suffixes by one more block and parts them into intervals
   of equal ones. An entry that gets an interval to itself repeats nothing, nor does any that leads to
   it, and is not carried on. After LENGTH / BLOCK rounds what is left are the windows that repeat.
4. Spans. The repeated windows of all runs are joined to the documents; their union is cut out.

A name with more than ``HOT`` different runs (a passage in a large share of all documents, with other
surroundings each time) is not given to one task: its windows are counted one by one by digest.

Copies of a text are one text (128-bit digests stand for texts, runs and windows); one copy's bytes
move for step 2. Null texts are empty; texts shorter than LENGTH keep all. Every row gets its result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .shared import arrow_rows, cut, gram_hashes, sorted_groups, text_bytes, tidy

LENGTH = 400
GRAM = 100
BLOCK = 25
HOT = 4096
SHARD_BYTES = 1 << 18
PACK_BYTES = 1 << 20
_PLACE_BITS = 20
_CHUNK = (1 << _PLACE_BITS) - 2 * LENGTH

_RUNS = pa.schema([("tid", pa.binary()), ("key", pa.int64()), ("digest", pa.binary()), ("start", pa.int64()), ("run", pa.int64()), ("again", pa.bool_())])
_RUNS_SQL = "tid binary, key bigint, digest binary, start bigint, run bigint, again boolean"


def window_runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, bool]]:
    """(name, start, number of windows, whether the least gram moves) of all runs of windows of one name."""
    place = np.uint64((1 << _PLACE_BITS) - 1)
    width = length - gram + 1
    for at in range(0, max(0, len(data) - length + 1), _CHUNK):
        part = np.frombuffer(data, np.uint8, min(_CHUNK + length - 1, len(data) - at), at)
        hashes = gram_hashes(part, gram)
        n = len(hashes)
        # the place in the low bits: equal hashes are told apart by the leftmost
        packed = np.full(-(-n // width) * width, ~np.uint64(0))
        packed[:n] = (hashes & ~place) | np.arange(n, dtype=np.uint64)
        rows = packed.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - width + 1
        least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
        names = (least >> np.uint64(_PLACE_BITS)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        ends = np.r_[starts[1:], windows]
        moves = least[starts] != least[ends - 1]
        yield from zip(names[starts].tolist(), (starts + at).tolist(), (ends - starts).tolist(), moves.tolist(), strict=True)


def _emit_runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest_of = xxhash.xxh3_128_digest

        def rows():
            for batch in batches:
                out = {name: [] for name in _RUNS.names}
                for tid, value in zip(batch.column("tid"), batch.column("data"), strict=True):
                    data, tid = value.as_py(), tid.as_py()
                    for name, start, n, again in window_runs(data, length, gram):
                        out["tid"].append(tid)
                        out["key"].append(name)
                        out["digest"].append(digest_of(data[start : start + n + length - 1]))
                        out["start"].append(start)
                        out["run"].append(n)
                        out["again"].append(again)
                yield out

        return arrow_rows(_RUNS, rows())

    return run


def stable_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0 on: one sort of plain integers, each key with its place in the low bits."""
    bits = len(keys).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits > 63:
        return np.argsort(keys, kind="stable")
    return np.sort(keys.astype(np.int64) << bits | np.arange(len(keys))) & ((1 << bits) - 1)


def _dense(values: np.ndarray) -> np.ndarray:
    """Ranks of values, from 1 on; equal values share one."""
    order = stable_order(values)
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.cumsum(np.diff(values[order], prepend=-1) != 0)
    return ranks


class Shard:
    """The transform of some segments: for every suffix in order, the number of the block before it (0: none)."""

    def __init__(self, symbols: np.ndarray, positions: np.ndarray, previous: np.ndarray, following: np.ndarray, depth: int, strings: int, last: np.ndarray):
        """``symbols`` by position; ``previous`` / ``following`` are the neighbouring positions of its string, -1 at the ends."""
        rank = _dense(symbols)
        reach, jump = 1, following.copy()
        while reach < depth:  # prefix doubling up to ``depth`` blocks, within the shard only
            after = np.where(jump >= 0, rank[jump], 0)
            rank = _dense(rank * (rank.max(initial=0) + 2) + after)
            jump = np.where(jump >= 0, jump[jump], -1)
            reach *= 2
        order = stable_order(rank)
        self.positions = positions[order]
        # the empty suffixes of all strings come first, in the strings' order
        before = np.where(previous[order] >= 0, symbols[previous[order]], 0)
        self.blocks = np.concatenate([symbols[last], before]).astype(np.int32)
        self.empty = strings

    def ahead(self) -> np.ndarray:
        """For each entry that of the suffix one block longer (-1: none): sorted by block, entries keep their order."""
        order = stable_order(self.blocks)
        order = order[np.searchsorted(self.blocks[order], 1) :]
        entry = np.full(len(self.blocks), -1)
        entry[order] = self.empty + np.arange(len(order))
        return entry


def _shard(strings: list[tuple[int, int]], symbols: np.ndarray, block: int, depth: int) -> Shard:
    """A shard of the strings between these positions; ``symbols`` holds the block at each position."""
    positions, previous, following, last, base, ends = [], [], [], [], 0, 0
    for start, end in strings:
        n = end - start - block + 1
        here = np.arange(n)
        positions.append(start + here)
        previous.append(np.where(here >= block, base + here - block, -1))
        following.append(np.where(here + block < n, base + here + block, -1))
        last.append(base + np.arange(max(0, n - block), n))
        ends += min(block, n)
        base += n
    positions = np.concatenate(positions)
    return Shard(symbols[positions], positions, np.concatenate(previous), np.concatenate(following), depth, ends, np.concatenate(last))


def merge(shards: list[Shard], depth: int) -> np.ndarray:
    """Entries, counted through all shards, of suffixes whose first ``depth`` blocks begin another suffix too, in suffix order.

    Only blocks of the transforms are read. Suffixes that no other one shares its blocks with make an
    interval of one entry. All that lead to it by further blocks are alone too, so it is left out.
    """
    blocks = np.concatenate([s.blocks for s in shards])
    base = np.cumsum([0, *(len(s.blocks) for s in shards)])
    ahead = np.concatenate([s.ahead() + at for s, at in zip(shards, base.tolist(), strict=False)])
    # before the first round nothing is compared: the shards' suffixes in turn, the empty ones among them
    entry, group = np.arange(len(blocks)), np.zeros(len(blocks), np.int64)
    for _ in range(depth):
        block = blocks[entry]
        order = stable_order(block)
        block = block[order]
        start = np.searchsorted(block, 1)  # nothing stands before a string's first block
        order, block = order[start:], block[start:]
        group = group[order]
        fresh = np.ones(len(order) + 1, bool)
        fresh[1:-1] = (block[1:] != block[:-1]) | (group[1:] != group[:-1])
        shared = ~(fresh[:-1] & fresh[1:])
        entry = ahead[entry[order[shared]]]
        group = np.cumsum(fresh[:-1][shared])
    return entry


def repeated_windows(segments: list[bytes], length: int = LENGTH, block: int = BLOCK, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each segment the offsets at which a string of ``length`` bytes starts that starts elsewhere in them too."""
    depth = length // block
    text = np.frombuffer(b"".join(segments), np.uint8)
    hashes = gram_hashes(text, block)
    _, symbols, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    one = np.empty(len(counts), np.int64)
    one[symbols] = np.arange(len(symbols))
    windows = np.lib.stride_tricks.sliding_window_view(text, block)
    for at in range(0, len(symbols), 1 << 16):  # equal hashes must be equal blocks
        if not np.array_equal(windows[at : at + (1 << 16)], windows[one[symbols[at : at + (1 << 16)]]]):
            _, symbols, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
            break
    symbols = symbols.ravel().astype(np.int64) + 1
    sizes = np.array([len(s) for s in segments])
    starts = np.cumsum([0, *sizes])
    # a string with a block that occurs once does not repeat: the transforms hold what the other strings cover
    again = counts[symbols - 1] > 1
    here = np.arange(len(text)) + length <= np.repeat(starts[1:], sizes)
    for at in range(0, length, block):
        here[: max(0, len(again) - at)] &= again[at:]
    shards, held, size = [], [], 0
    for a, b in ranges(np.flatnonzero(here), length):
        held.append((a, b + length - 1))
        size += b + length - 1 - a
        if size >= shard_bytes:
            shards.append(_shard(held, symbols, block, depth))
            held, size = [], 0
    if held:
        shards.append(_shard(held, symbols, block, depth))
    if not shards:
        return [np.empty(0, np.int64) for _ in segments]
    # the empty suffixes have no place, and share no block
    positions = np.concatenate([np.r_[np.full(s.empty, -1), s.positions] for s in shards])
    places = np.sort(positions[merge(shards, depth)])
    out = []
    for start, segment in zip(starts[:-1].tolist(), segments, strict=True):
        low, high = np.searchsorted(places, [start, start + len(segment) - length + 1])
        out.append(places[low:high] - start)
    return out


def ranges(offsets: np.ndarray, apart: int = 2) -> list[tuple[int, int]]:
    """Sorted offsets as half-open ranges; those ``apart`` or more from the one before begin a new one."""
    if not len(offsets):
        return []
    breaks = np.flatnonzero(np.diff(offsets) >= apart)
    return list(zip(offsets[np.r_[0, breaks + 1]].tolist(), (offsets[np.r_[breaks, len(offsets) - 1]] + 1).tolist(), strict=True))


_SEGMENTS_SQL = "key bigint, digest binary, bytes binary"
_FOUND_SQL = "key bigint, digest binary, a bigint, b bigint"


def _compare(length: int, block: int):
    """Segments sorted by (key, digest) to the ranges of their repeated windows; whole keys are compared together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, size, last = [], 0, None

        def results():
            out = {"key": [], "digest": [], "a": [], "b": []}
            for (key, digest, _), offsets in zip(pack, repeated_windows([s for _, _, s in pack], length, block), strict=True):
                for a, b in ranges(offsets):
                    for name, value in (("key", key), ("digest", digest), ("a", a), ("b", b)):
                        out[name].append(value)
            return out

        def rows():
            nonlocal pack, size, last
            for batch in batches:
                for key, digest, segment in zip(batch.column("key").to_pylist(), batch.column("digest").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                    if (key, digest) == last:
                        continue  # another copy of the same text
                    if size >= PACK_BYTES and key != last[0]:
                        yield results()
                        pack, size = [], 0
                    pack.append((key, digest, segment))
                    size, last = size + len(segment), (key, digest)
            if pack:
                yield results()

        return arrow_rows(pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("a", pa.int64()), ("b", pa.int64())]), rows())

    return run


def _cut_segments(length: int):
    """A text with its wanted runs to their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()

        def rows():
            for batch in batches:
                out = {"key": [], "digest": [], "bytes": []}
                for value, wanted in zip(batch.column("data"), batch.column("wanted").to_pylist(), strict=True):
                    data = value.as_py()
                    for w in wanted:
                        if w["digest"] in sent:
                            continue
                        if len(sent) > 100_000:
                            sent.clear()
                        sent.add(w["digest"])
                        out["key"].append(w["key"])
                        out["digest"].append(w["digest"])
                        out["bytes"].append(data[w["start"] : w["start"] + w["run"] + length - 1])
                yield out

        return arrow_rows(pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("bytes", pa.binary())]), rows())

    return run


def _cut_windows(length: int):
    """Runs' bytes to the digests of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for key, digest, segment in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "bytes")), strict=True):
                    n = len(segment) - length + 1
                    yield {"key": [key] * n, "digest": [digest] * n, "a": np.arange(n), "window": [xxhash.xxh3_128_digest(segment[i : i + length]) for i in range(n)]}

        return arrow_rows(pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("a", pa.int64()), ("window", pa.binary())]), rows())

    return run


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """Of rows (id, tid, data): for each text (tid) the spans (a, b) of windows that repeat, as an array ``spans``."""
    runs = cut(texts.where(F.octet_length("data") >= length).select("tid", "data").mapInArrow(_emit_runs(length, gram), _RUNS_SQL))
    by_bytes = cut(runs.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tid", "start")).alias("rep"), F.first("run").alias("run"), F.max("again").alias("again")))
    names = by_bytes.groupBy("key").agg(F.count(F.lit(1)).alias("variants"), F.max("again").alias("moves"))
    names = names.where("variants > 1 OR moves").select("key", (F.col("variants") > hot).alias("hot"))
    # one representative of every run that shares its name with other bytes; one copy of each text carries them
    wanted = by_bytes.join(names, "key")
    wanted = wanted.select(F.col("rep.tid").alias("tid"), F.struct("key", "digest", F.col("rep.start").alias("start"), "run").alias("w"), "hot")
    wanted = wanted.groupBy("tid", "hot").agg(F.collect_list("w").alias("wanted"))
    one = texts.groupBy("tid").agg(F.min("id").alias("one"), F.lit(True).alias("known"))
    wanted = cut(wanted.join(one, "tid"))
    carrier = texts.join(wanted.withColumnRenamed("tid", "w_tid"), (F.col("tid") == F.col("w_tid")) & F.col("id").eqNullSafe(F.col("one")))
    segments = cut(carrier.where("NOT hot").select("data", "wanted").mapInArrow(_cut_segments(length), _SEGMENTS_SQL))
    tidy(texts.sparkSession)
    compared = sorted_groups(segments, "key", "digest").mapInArrow(_compare(length, block), _FOUND_SQL)
    dense = carrier.where("hot").select("data", "wanted").mapInArrow(_cut_segments(length), _SEGMENTS_SQL).dropDuplicates(["key", "digest"])
    windows = cut(dense.mapInArrow(_cut_windows(length), "key bigint, digest binary, a bigint, window binary"))
    twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    counted = windows.join(twice, "window", "left_semi").select("key", "digest", "a", (F.col("a") + 1).alias("b"))
    same = by_bytes.where("n > 1").select("key", "digest", F.lit(0).cast("bigint").alias("a"), F.col("run").alias("b"))
    found = cut(same.unionByName(compared).unionByName(counted))
    spans = runs.select("tid", "key", "digest", "start").join(found, ["key", "digest"])
    spans = spans.groupBy("tid").agg(F.collect_set(F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + length - 1).alias("b"))).alias("spans"))
    tidy(texts.sparkSession)
    return cut(spans)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, n_spans, sums, sizes = [], [], [], []
        for value, spans in zip(batch.column("data"), batch.column("spans").to_pylist(), strict=True):
            data, done, gone, n, kept = value.as_py(), 0, 0, 0, hashlib.sha256()
            covered = -1
            for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                if a > covered:
                    kept.update(data[done:a])
                    n += 1
                if b > covered:
                    gone += b - max(a, covered, 0)
                    covered = done = b
            kept.update(data[done:])
            sizes.append(len(data))
            removed.append(gone)
            n_spans.append(n)
            sums.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sums, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    texts = docs.select(F.col(id_column).alias("id"), text_bytes(text).alias("data")).withColumn("tid", F.unhex(F.md5("data")))
    spans = repeated_spans(texts, **sizes)
    joined = texts.join(spans, "tid", "left").select("id", "data", "spans")
    id_type = docs.schema[id_column].dataType.simpleString()
    return joined.mapInArrow(_remove, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
