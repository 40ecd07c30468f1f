"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Words are parted at ASCII blanks and ASCII case is dropped; a text of fewer than five words is one
shingle, and texts without words are copies of each other.

* Texts of the same words are combined first. Each remaining text has a SimHash fingerprint of its shingles, and fingerprints
  at four or fewer bits are linked over Golay codeword keys, as op1 does (``simhash_dedup.near_links``). Those links are candidates. Most
  pairs at 0.8 are further apart than that (some ten of 64 bits), so they are not the only ones:
* Each text also has 128 minimum hashes, cut into 32 bands of four; a pair at 0.8 shares no band with a probability of 5e-8.
  Texts of one band's key meet in a sorted stream. A pair is a candidate if the numbers of shingles allow 0.8 and at least
  ``LEAST_ALIKE`` of the minima agree (a pair at 0.8 has 102 on average, and fewer than 72 with a probability below 1e-9).
* Candidates are verified on their shingles in a join; only the shingles decide.
* A bucket of over ``SMALL_BUCKET`` texts gives no pairs to that join but a spanning forest of such as agree in at least
  ``SURELY`` minima. Where its texts are still in different components after that, they meet once more together with their shingles, and pairs of
  different components are verified in the stream, of which only links that join two components come out. So a group of near copies
  costs rows in proportion to its size whatever its pairs are like, and no link is left out. What is compared there is all pairs of
  different components; a bucket beyond ``BLOCK`` texts or ``BLOCK_SHINGLES`` shingles is dealt over several tasks in pairs of blocks.

A text without words, null and empty ones included, is a copy of every other such text. Repeated rows are copies. An empty table
stays empty. Long texts are hashed whole. Columns of any name come back as they are; the ones added on the way have names that are not taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import Joined, arrow_rows, connected, cut, gram_hashes, signed, sorted_groups, text_bytes

WORDS = 5
BANDS = 32
ROWS_A_BAND = 4
LEAST_ALIKE = 72  # of BANDS * ROWS_A_BAND minima
SURELY = 104
SMALL_BUCKET = 4
BLOCK = 2048
BLOCK_SHINGLES = 2_000_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CHUNK = 512
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS_A_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: bytes) -> np.ndarray:
    """Distinct hashes of the five-word shingles of UTF-8 bytes, sorted; none without words."""
    words = data.translate(_LOWER).split()
    if len(words) <= WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], dtype=np.uint64)
    return np.unique(gram_hashes(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), WORDS))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the shingles."""
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for at in range(0, len(hashes), _CHUNK):
        np.minimum(least, (hashes[None, at : at + _CHUNK] * _FACTORS[:, None]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of each row of minima."""
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), BANDS)).copy()
    for part in np.moveaxis(least.reshape(len(least), BANDS, ROWS_A_BAND), 2, 0):
        key = (key ^ part) * _MIX
        key ^= key >> np.uint64(29)
    return key


def _digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(b" ".join(data.translate(_LOWER).split()))


@F.pandas_udf(T.StringType())
def _digests(texts: pd.Series) -> pd.Series:
    return pd.Series([_digest(bytes(t)) for t in texts], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _shingle_sets(texts: pd.Series) -> pd.Series:
    return pd.Series([signed(shingles(bytes(t))) for t in texts], dtype=object)


@F.pandas_udf(T.StructType().add("words", T.StringType()).add("n", T.IntegerType()).add("keys", T.BinaryType()).add("sketch", T.BinaryType()).add("fp", T.LongType()))
def _sketches(texts: pd.Series) -> pd.DataFrame:
    from .simhash_dedup import majority  # that module hands out this one's drop_near_duplicates

    rows = []
    for text in texts:
        data = bytes(text)
        hashes = shingles(data)
        least = minima(hashes)
        fp = int(np.uint64(majority(hashes)).view(np.int64))
        rows.append((_digest(data), len(hashes), band_keys(least[None])[0].tobytes(), ((least * _MIX) >> np.uint64(56)).astype(np.uint8).tobytes(), fp))
    return pd.DataFrame(rows, columns=["words", "n", "keys", "sketch", "fp"])


_KEYED = pa.schema([("key", pa.int64()), ("v", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary(BANDS * ROWS_A_BAND)), ("root", pa.int64())])
_KEYED_SQL = "key bigint, v bigint, n int, sketch binary, root bigint"
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once for each band."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            keys = np.frombuffer(b"".join(part.column("keys").to_pylist()), np.int64)
            owner = pa.array(np.repeat(np.arange(part.num_rows), BANDS))
            others = [part.column(name).take(owner) for name in ("v", "n")]
            sketch = part.column("sketch").take(owner).cast(pa.binary(BANDS * ROWS_A_BAND))
            yield pa.RecordBatch.from_arrays([pa.array(keys), *others, sketch.cast(pa.binary()), part.column("root").take(owner)], names=_KEYED.names)


def _alike(n: np.ndarray, sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the texts at places a and b may reach 0.8."""
    few, many = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    may = 5 * few >= 4 * many
    may[may] = (sketch[a[may]] == sketch[b[may]]).sum(axis=1) >= LEAST_ALIKE
    return may


def _forest(n: np.ndarray, sketch: np.ndarray, members: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join the members of a bucket which are surely alike: a breadth-first search."""
    rest = members
    while len(rest) > 1:
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = (5 * np.minimum(n[rest], n[at]) >= 4 * np.maximum(n[rest], n[at])) & ((sketch[rest] == sketch[at]).sum(axis=1) >= SURELY)
            found, rest = rest[near].tolist(), rest[~near]
            yield from ((at, other) for other in found)
            frontier += found


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows sorted by key as (keys, columns ...), such that the rows of a key are in one piece; lists come as (values, lengths)."""

    def arrays(batch):
        out = [batch.column("key").to_numpy(zero_copy_only=False)]
        for name in columns:
            column = batch.column(name)
            if name == "sketch":
                out.append(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS_A_BAND))
            elif name == "shingles":
                out.append(column.flatten().to_numpy(zero_copy_only=False))
                out.append(np.asarray(pc.list_value_length(column)))
            else:
                out.append(column.to_numpy(zero_copy_only=False))
        return out

    held = []  # parts of a key that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1]))
        if last or (held and held[0][0][0] != keys[0]):
            held += [arrays(batch.slice(0, last))] if last else []
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held = []
        held.append(arrays(batch.slice(last)))
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _candidates():
    """Sorted rows to candidate pairs: those of small buckets and forests of large ones, which also come back as a row with a = b and their key."""

    def whole(keys, v, n, sketch, joined):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        few = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL_BUCKET), sizes))
        for far in range(1, SMALL_BUCKET):
            at = np.flatnonzero(keys[few[far:]] == keys[few[:-far]]) if len(few) > far else np.empty(0, np.int64)
            if not len(at):
                break
            for i in range(0, len(at), 4096):
                a, b = few[at[i : i + 4096]], few[at[i : i + 4096] + far]
                may = _alike(n, sketch, a, b)
                yield {"a": v[a[may]], "b": v[b[may]], "key": np.zeros(may.sum(), np.int64)}
        large = sizes > SMALL_BUCKET
        for start, size in zip(starts[large].tolist(), sizes[large].tolist(), strict=True):
            yield {"a": v[start : start + 1], "b": v[start : start + 1], "key": keys[start : start + 1]}
            links = [(int(v[a]), int(v[b])) for a, b in _forest(n, sketch, np.arange(start, start + size))]
            links = [link for link in links if joined.new(*link)]
            if links:
                a, b = np.array(links, np.int64).T
                yield {"a": a, "b": b, "key": np.zeros(len(a), np.int64)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined()
        return arrow_rows(_PAIRS, (found for group in _whole_groups(batches, ["v", "n", "sketch"]) for found in whole(*group, joined)))

    return run


def _links_between(v: np.ndarray, n: np.ndarray, sketch: np.ndarray, root: np.ndarray, shingles: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places of links at 0.8 that join the members of a bucket which have different roots: a breadth-first search on their shingles."""
    codes = np.unique(shingles, return_inverse=True)[1]
    ends = np.cumsum(n, dtype=np.int64)
    starts = ends - n
    mark = np.zeros(codes.max() + 1, bool)
    rest = np.arange(len(v))
    while len(rest) > 1:
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = root[rest] == root[at]
            others = np.flatnonzero(~near)
            others = others[_alike(n, sketch, rest[others], np.full(len(others), at))]
            if len(others):
                own = codes[starts[at] : ends[at]]
                mark[own] = True
                shared = np.add.reduceat(mark[codes], starts, dtype=np.int64)[rest[others]]
                mark[own] = False
                others = others[9 * shared >= 4 * (n[rest[others]] + n[at])]
                yield from ((at, other) for other in rest[others].tolist())
                near[others] = True
            frontier += rest[near].tolist()
            rest = rest[~near]


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with shingles to links that join different roots."""
    joined = Joined()

    def whole(keys, v, n, sketch, root, shingles, sizes):
        places = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist()
        for start, stop in zip(starts, [*starts[1:], len(keys)], strict=True):
            part = slice(start, stop)
            links = _links_between(v[part], n[part].astype(np.int64), sketch[part], root[part], shingles[places[start] : places[stop]])
            links = [(int(v[start + a]), int(v[start + b])) for a, b in links if joined.new(int(root[start + a]), int(root[start + b]))]
            if links:
                a, b = np.array(links, np.int64).T
                yield {"a": a, "b": b}

    return arrow_rows(_LINKS, (found for group in _whole_groups(batches, ["v", "n", "sketch", "root", "shingles"]) for found in whole(*group)))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of candidates (a, b) those whose shingles reach 0.8."""
    left = sets.select(F.col("v").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("v").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(9 * shared >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def _fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """Candidates (a, b) that op1's method links: one text of each fingerprint with its others, and those of fingerprints at four or fewer bits."""
    from .simhash_dedup import near_links

    prints = cut(texts.groupBy("fp").agg(F.min("v").alias("first")))
    same = texts.join(prints, "fp").where("v <> first").select(F.col("first").alias("a"), F.col("v").alias("b"))
    ends = [prints.select(F.col("fp").alias(name), F.col("first").alias(f"v_{name}")) for name in ("a", "b")]
    near = near_links(prints).join(ends[0], "a").join(ends[1], "b")
    return same.unionByName(near.select(F.least("v_a", "v_b").alias("a"), F.greatest("v_a", "v_b").alias("b")))


def _in_blocks(members: DataFrame) -> DataFrame:
    """Members of buckets of one block as they are; those of more blocks once for each other block, under a key of the two."""
    block = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") > 1, F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block"))).otherwise(F.array(F.lit(0)))
    dealt = members.withColumn("block", block).withColumn("other", F.explode(others))
    return dealt.withColumn("key", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))).select(*_KEYED.names)


def near_copy_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, groups): (_id, words) of each row, and (words, root) for each different text, whose ``root`` names its group."""
    prints = cut(docs.select(F.col(id_column).alias("_id"), _sketches(text_bytes(text)).alias("s")).select("_id", "s.words", "s.n", "s.keys", "s.sketch", "s.fp"))
    texts = prints.groupBy("words").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp"))
    texts = cut(texts.withColumn("v", F.monotonically_increasing_id()))

    def keyed(rooted: DataFrame) -> DataFrame:
        return rooted.where("n > 0").select("v", "n", "keys", "sketch", "root").mapInArrow(_emit_keys, _KEYED_SQL)

    def shingle_sets(nodes: DataFrame) -> DataFrame:
        needed = nodes.distinct().join(texts.select("v", "words"), "v")
        held = docs.select(_digests(text_bytes(text)).alias("words"), text_bytes(text).alias("data")).join(needed, "words")
        one = held.groupBy("v").agg(F.first("data").alias("data"))
        return cut(one.select("v", _shingle_sets("data").alias("shingles")))

    buckets = sorted_groups(keyed(texts.withColumn("root", F.col("v"))).select("key", "v", "n", "sketch"), "key", "v")
    found = cut(buckets.mapInArrow(_candidates(), "a bigint, b bigint, key bigint"))
    pairs = cut(found.where("a <> b").select("a", "b").unionByName(_fingerprint_pairs(texts.where("n > 0"))).distinct())
    links = cut(_verified(pairs, shingle_sets(pairs.select(F.col("a").alias("v")).union(pairs.select("b")))))
    large = cut(found.where("a = b").select("key").distinct())
    roots = connected(links)
    if not large.isEmpty():
        rooted = texts.join(roots.withColumnRenamed("node", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
        members = cut(keyed(rooted).join(large, "key", "left_semi"))
        apart = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"), F.min("root").alias("low"), F.max("root").alias("high"))
        blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
        members = cut(members.join(apart.where("low <> high").select("key", blocks.alias("blocks")), "key"))
        if not members.isEmpty():
            more = _in_blocks(members).join(shingle_sets(members.select("v")), "v")
            more = cut(sorted_groups(more, "key", "v").mapInArrow(_exact, "a bigint, b bigint"))
            roots = connected(links.unionByName(more))
    groups = texts.join(roots.withColumnRenamed("node", "v"), "v", "left").select("words", F.coalesce("root", "v").alias("root"))
    return prints.select("_id", "words"), cut(groups)


def _keeper_keys(row_id: str, words: str, names: list[str]) -> list[Column]:
    """An id that may be null and a digest as join keys without nulls."""
    keys = [F.coalesce(F.col(row_id).cast("string"), F.lit("")), F.col(row_id).isNull(), F.col(words)]
    return [key.alias(name) for key, name in zip(keys, names, strict=True)]


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; columns as given.

    A null id is the smallest only where there is no other. Of rows that share that id, the
    smallest digest stays, once.
    """
    rows, groups = near_copy_groups(docs, id_column, text)
    least = rows.groupBy("words").agg(F.min("_id").alias("_id")).join(groups, "words")  # one row a text: copies are combined before they move
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("_id"), F.col("words").alias("words"))).alias("first")
    taken = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))  # no column begins with that many
    words, *keys = (f"{taken}{name}" for name in ("words", "k1", "k2", "k3"))
    keepers = cut(least.groupBy("root").agg(first).select("first.*").select(*_keeper_keys("_id", "words", keys)))
    marked = docs.withColumn(words, _digests(text_bytes(text)))
    marked = marked.select("*", *_keeper_keys(id_column, words, keys))
    return marked.join(keepers, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
