"""SimHash near-duplicates found with the binary Golay code.

A document's fingerprint holds, bit by bit, the majority of its shingles' hashes. Fingerprints at
few differing bits are found without comparing all pairs:

* The 64 bits are cut into three segments, each a word of the perfect (23, 12) Golay code with
  zeros in front. A word has one codeword within distance 3, and, when that distance is 3, five
  more at distance 4. Two words at 2 or fewer differing bits always share one of these one or six
  codewords: a word halfway between them lies within 3 of some codeword, which is then within 4 of
  both.
* With at most 4 differing bits over three segments, either every segment has at most 2, so all
  three segments share a codeword (key: three 12-bit indices), or one segment has 3 or more, so of
  the others one is equal and one differs by at most 1 (key: the equal segment's bits and the
  other's codeword index). No pair within 4 bits is missed.
* Rows of one key meet in a sorted stream and are verified on all 64 bits. A bucket yields a
  spanning forest of its links, never all pairs; a bucket beyond ``HOT_BUCKET`` members is dealt
  anew on the 70 ways to agree in four of eight bytes, which any pair within 4 bits does.

Distinct fingerprints are linked, so copies are combined before anything is compared. Null and
empty texts have fingerprint zero and link like any other; a null doc_id never is the smallest of
a component unless it is the only one; repeated rows each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .jaccard_dedup import drop_near_duplicates  # noqa: F401
from .shared import Joined, arrow_rows, connected, cut, signed, sorted_groups, text_bytes

MAX_BITS = 4
WORDS = 4
SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (lowest bit, width) of each segment
HOT_BUCKET = 20_000
SMALL_BUCKET = 12
GENERATOR = 0b101011100011  # of the (23, 12) code
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CHUNK = 1 << 16
_KEYED_AT_ONCE = 512  # a fingerprint has up to 252 keys


def fingerprint(data: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of UTF-8 bytes; 0 without words."""
    tokens = data.translate(_LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n, hash_of = len(tokens), xxhash.xxh64_intdigest
    if n <= words:
        return majority([hash_of(joined, seed)])
    lengths = np.fromiter(map(len, tokens), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    return majority([hash_of(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)])


def majority(hashes: list[int] | np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[at : at + _CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(signed(np.array([fingerprint(bytes(t)) for t in texts], dtype=np.uint64)))


def fingerprint_column(text: str = "text") -> Column:
    """The fingerprint as a (signed) long."""
    return _fingerprints(text_bytes(text))


def _golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the 12 message bits, and by syndrome the nearest error patterns and their number."""
    remainder = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        remainder = np.where(remainder >> bit & 1, remainder ^ (GENERATOR << (bit - 11)), remainder)
    syndrome = lambda word: int(remainder[word >> 11] ^ (word & 0x7FF))
    errors, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        for places in combinations(range(23), weight):
            word = sum(1 << p for p in places)
            s = syndrome(word)
            if weight < 4 or errors[s, 0].item().bit_count() == 3:
                errors[s, count[s]] = word
                count[s] += 1
    return remainder, errors, count


def codeword_indices(words: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word its one or six codeword indices (n x 6) and how many there are."""
    remainder, errors, count = tables
    s = remainder[words >> 11] ^ (words & 0x7FF)
    return (words[:, None] ^ errors[s]) >> 11, count[s]


def golay_keys(prints: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows such that any two fingerprints within MAX_BITS share a key."""
    prints = prints.astype(np.uint64, copy=False)
    raw = [((prints >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    index, count = zip(*(codeword_indices(r, tables) for r in raw), strict=True)
    slot = np.arange(6)
    valid = [slot < c[:, None] for c in count]
    mask = valid[0][:, :, None, None] & valid[1][:, None, :, None] & valid[2][:, None, None, :]
    three = (index[0][:, :, None, None] << 24) | (index[1][:, None, :, None] << 12) | index[2][:, None, None, :]
    keys, owners = [three[mask]], [np.nonzero(mask)[0]]
    tag = 1
    for i in range(3):
        for j in range(3):
            if i != j:
                two = (tag << 40) | (raw[i][:, None] << 12) | index[j]
                keys.append(two[valid[j]])
                owners.append(np.nonzero(valid[j])[0])
                tag += 1
    return np.concatenate(keys), prints[np.concatenate(owners)]


_KEYED = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
_LINKED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = _golay_tables()

    def rows():
        for batch in batches:
            words = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(words), _KEYED_AT_ONCE):
                keys, prints = golay_keys(words[at : at + _KEYED_AT_ONCE], tables)
                yield {"key": keys, "fp": signed(prints)}

    return arrow_rows(_KEYED, rows())


def _emit_byte_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of hot buckets again, once for each choice of four of the eight bytes."""
    masks = [sum(0xFF << 8 * b for b in chosen) for chosen in combinations(range(8), 4)]

    def rows():
        for batch in batches:
            prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            key = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            for at, mask in enumerate(masks):
                mixed = ((prints & np.uint64(mask)) ^ (key * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(at)) * np.uint64(0xD6E8FEB86659FD93)
                yield {"key": signed(mixed ^ (mixed >> np.uint64(32))), "fp": signed(prints)}

    return arrow_rows(_KEYED, rows())


def _forest(members: np.ndarray, max_bits: int) -> tuple[list, list]:
    """Links that join the members of a bucket into its components: a breadth-first search in tiles."""
    rest, left, right = members.copy(), [], []
    while len(rest):
        root, frontier, rest = rest[0], rest[:1], rest[1:]
        while len(frontier) and len(rest):
            tile, frontier = frontier[:64], frontier[64:]
            near = np.zeros(len(rest), bool)
            for word in tile:
                near |= np.bitwise_count(rest ^ word) <= max_bits
            found, rest = rest[near], rest[~near]
            left += [root] * len(found)
            right += found.tolist()
            frontier = np.concatenate([frontier, found])
    return left, right


def _linker(max_bits: int, hot: int | None):
    """Sorted (key, fp) rows to links; members of buckets beyond ``hot`` come back with a = b and their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined()
        held_key, held, streaming = None, [], False

        def links(left, right):
            pairs = [(int(a), int(b)) for a, b in zip(left, right, strict=True)]
            pairs = [p for p in pairs if joined.new(*p)]
            if pairs:
                a, b = (np.array(x, dtype=np.uint64) for x in zip(*pairs, strict=True))
                yield {"a": signed(a), "b": signed(b), "key": np.zeros(len(a), np.int64)}

        def members(prints, key):
            yield {"a": signed(prints), "b": signed(prints), "key": np.full(len(prints), key, np.int64)}

        def whole(keys, prints):
            """Buckets that are complete in these arrays."""
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            left, right = [], []
            small = np.repeat((sizes > 1) & (sizes <= SMALL_BUCKET), sizes)
            few, words = keys[small], prints[small]
            for far in range(1, SMALL_BUCKET):
                at = np.flatnonzero(few[far:] == few[:-far]) if len(few) > far else np.empty(0, np.int64)
                if not len(at):
                    break
                near = at[np.bitwise_count(words[at] ^ words[at + far]) <= max_bits]
                left += words[near].tolist()
                right += words[near + far].tolist()
            for start, size in zip(starts[sizes > SMALL_BUCKET].tolist(), sizes[sizes > SMALL_BUCKET].tolist(), strict=True):
                a, b = _forest(prints[start : start + size], max_bits)
                left += a
                right += b
            yield from links(left, right)

        def rows():
            nonlocal held_key, held, streaming
            for batch in batches:
                keys = batch.column("key").to_numpy(zero_copy_only=False)
                prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                last = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
                if held_key is not None:
                    first = int(np.searchsorted(keys, held_key, side="right")) if keys[0] == held_key else 0
                    if streaming:
                        if first:
                            yield from members(prints[:first], held_key)
                    else:
                        held.append(prints[:first])
                        if hot is not None and sum(map(len, held)) > hot:
                            yield from members(np.concatenate(held), held_key)
                            held, streaming = [], True
                    if first == len(keys):
                        continue
                    if not streaming:
                        done = np.concatenate(held)
                        if len(done) > 1:
                            yield from whole(np.full(len(done), held_key), done)
                    keys, prints, last = keys[first:], prints[first:], last - first
                    held, streaming = [], False
                if last > 0:
                    yield from whole(keys[:last], prints[:last])
                held_key, held = int(keys[-1]), [prints[last:]]
            if held_key is not None and not streaming:
                done = np.concatenate(held)
                if len(done) > 1:
                    yield from whole(np.full(len(done), held_key), done)

        return arrow_rows(_LINKED, rows())

    return run


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT_BUCKET) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints ``fp`` within ``max_bits`` (at most 4)."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys find pairs within {MAX_BITS} bits")
    keyed = prints.select("fp").mapInArrow(_emit_keys, "key bigint, fp bigint")
    found = cut(sorted_groups(keyed, "key").mapInArrow(_linker(max_bits, hot), "a bigint, b bigint, key bigint"))
    dense = found.where("a = b").select("key", F.col("a").alias("fp")).mapInArrow(_emit_byte_keys, "key bigint, fp bigint").distinct()
    again = sorted_groups(dense, "key").mapInArrow(_linker(max_bits, None), "a bigint, b bigint, key bigint")
    return found.where("a <> b").select("a", "b").unionByName(again.select("a", "b"))


def fingerprint_groups(prints: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Of rows (id, fp): a row (fp, root, component_id) for each distinct fingerprint.

    ``root`` names the component; ``component_id`` is the smallest id of all rows in it.
    """
    distinct = cut(prints.groupBy("fp").agg(F.min(id_column).alias("first_id")))
    roots = connected(near_links(distinct)).withColumnRenamed("node", "fp")
    rooted = cut(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.select("fp", "root").join(lowest, "root")


def simhash_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's id, ``fp`` (long), ``fingerprint`` (hex) and ``component_id``."""
    prints = cut(docs.select(F.col(id_column).alias("row_id"), fingerprint_column(text).alias("fp")))
    groups = fingerprint_groups(prints, "row_id")
    return prints.join(groups, "fp").select(F.col("row_id").alias(id_column), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
