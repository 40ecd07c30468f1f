"""The trie of conversations' prefixes, with totals of every subtree. Time-forward processing.

A conversation's first d turns (role and text) are a node of depth d; conversations that start alike share
nodes. A node is named by its smallest member and its depth. The number of members, of members that end there,
of children, of leaves below, and the text that sharing saves come for every node.

* Turns get their places from one range-partitioned sort, so a conversation of any length is many tasks' work.
  Turns of equal number (null first) are ordered by the digest of role and text; repeated rows are turns of their own.
* A prefix is known by two 64-bit values, the exclusive or of hashes of (place, SHA-256 of role and text) over its
  turns: two prefixes are taken for one with a probability of about n^2 / 2^129. Running values are computed within
  blocks of turns and carried from block to block.
* Nodes are dealt into shards: connected pieces of the tree whose numbers of members lie in one power of 64 and whose
  depths lie in one band of 64. A shard has fewer than 64 * 64 nodes, however long one conversation or frequent one beginning is.
* Within shards nodes come in reverse level order (sorted by Spark, spilling), and every node sends its totals to its parent
  through a priority queue in that order, which spills. A shard's root sends them on to the shard that holds its parent:
  shards form a tree again, which is dealt and processed alike with powers and bands of 64^2, 64^3, ..., until
  ``FINAL`` nodes are left. On the way back every shard gets the totals of the shards below it, summed for each node.

Rows with a null conversation take no part; a null role or text is empty. An empty table gives no rows, not even a root.
A conversation may have no turns (after ``rebuilt``) and then is a member of the root alone. Only the four named
columns are read, so others, whatever their names, take no part. Very long texts are hashed where they are read and not moved.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .shared import cut

BITS = 6  # a shard spans a power of 2 ** BITS of members and a band of 2 ** BITS depths
FINAL = 50_000  # nodes of the last level, which one task takes
BLOCK = 1024  # turns whose running hashes are computed together
IDS = 4096  # range of conversation ids whose list is one row
QUEUE = 200_000  # messages a queue holds before it spills


class MessageQueue:
    """Messages (depth, node, three sums) by falling depth and rising node; more than ``limit`` go to sorted runs.

    Runs lie in an unnamed temporary file of the task itself, as Spark's own spills do: they go with the task
    attempt, and another attempt makes them anew.
    """

    _record = struct.Struct("<5q")

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.runs, self.spills = limit, [], [], 0

    def push(self, depth: int, node: int, *sums: int) -> None:
        heapq.heappush(self.heap, (-depth, node, *sums))
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.heap.sort()
        file = tempfile.TemporaryFile()
        for start in range(0, len(self.heap), 4096):
            file.write(b"".join(self._record.pack(*r) for r in self.heap[start : start + 4096]))
        file.seek(0)
        self.heap, self.spills = [], self.spills + 1
        records = self._read(file)
        heapq.heappush(self.runs, (next(records), self.spills, records))

    def _read(self, file) -> Iterator[tuple]:
        with file:
            while data := file.read(self._record.size * 4096):
                yield from self._record.iter_unpack(data)

    def take(self, depth: int, node: int) -> tuple[int, int, int]:
        """Sums of all messages to a node."""
        a = b = c = 0
        key = (-depth, node)
        while self.heap and self.heap[0][:2] == key:
            _, _, x, y, z = heapq.heappop(self.heap)
            a, b, c = a + x, b + y, c + z
        while self.runs and self.runs[0][0][:2] == key:
            (_, _, x, y, z), number, records = self.runs[0]
            a, b, c = a + x, b + y, c + z
            following = next(records, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, records))
        return a, b, c


def _forward(nodes: DataFrame, limit: int = QUEUE) -> DataFrame:
    """Nodes with the totals (children, leaves, saved) of their subtrees within the shard.

    ``nodes`` has node, depth, parent, parent_depth, shard, shard_depth, mark and the nodes' own children, leaves and
    saved, in which what came from other shards is already counted.
    """
    ordered = nodes.repartition("shard", "shard_depth").sortWithinPartitions(F.desc("depth"), "node")
    names = ["node", "depth", "parent", "parent_depth", "mark", "children", "leaves", "saved"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = MessageQueue(limit)
        for batch in batches:
            totals = [[], [], []]
            for node, depth, parent, parent_depth, mark, children, leaves, saved in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                more = queue.take(depth, node)
                totals[0].append(children + more[0])
                totals[1].append(leaves + more[1])
                totals[2].append(saved + more[2])
                if not mark:
                    queue.push(parent_depth, parent, 1, leaves + more[1], saved + more[2])
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {n: pa.array(t, pa.int64()) for n, t in zip(names[5:], totals, strict=True)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return ordered.mapInArrow(run, ordered.schema)



def ranked(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, digest, points) of every turn; place counts from 0 in the order of turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.length(text).cast("bigint").alias("points"), F.monotonically_increasing_id().alias("row"))
    order = ["conv", "turn", "digest", "row"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.select("conv", "digest", "points", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    # a conversation's rows of one partition are neighbours; only their numbers are looked back over
    spans = placed.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("conv", "part", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(spans, ["conv", "part"]).select("conv", (F.col("at") - F.col("first") + F.col("before")).cast("bigint").alias("place"), "digest", "points")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their hundred does: (turns of new places, (conv) of all).

    With h = crc32 of the decimal id % 6, conversation c has the first h turns of c - c % 100, then its own turns after its first h.
    """
    sizes = cut(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("size")))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    convs = sizes.select("conv", (F.col("conv") - F.col("conv") % 100).alias("base"), h.alias("h"))
    bases = sizes.where("conv % 100 = 0").select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    convs = cut(convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_size", F.lit(0)))))
    first = turns.where("conv % 100 = 0 AND place < 6").withColumnRenamed("conv", "base")
    heads = first.join(convs, "base").where("place < h").select("conv", "place", "digest", "points")
    tails = turns.join(convs, "conv").where("place >= h").select("conv", (F.col("place") - F.col("h") + F.col("head")).alias("place"), "digest", "points")
    return heads.unionByName(tails), convs.select("conv")


def _paths(turns: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, points, last): every turn with the hashes of the prefix that ends in it."""
    rows = turns.withColumn("depth", (F.col("place") + 1).cast("bigint")).withColumn("block", F.floor(F.col("place") / BLOCK))
    rows = rows.withColumns({"x1": F.xxhash64("digest", "depth"), "x2": F.xxhash64("depth", F.lit("second"), "digest")}).drop("digest")
    block = Window.partitionBy("conv", "block").orderBy("depth")
    run = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("conv", "block", "depth", "points", F.bit_xor("x1").over(run).alias("k1"), F.bit_xor("x2").over(run).alias("k2"), F.lead("depth").over(block).isNull().alias("last_of_block"))
    rows = cut(rows)
    ends = rows.where("last_of_block").select("conv", "block", F.col("k1").alias("e1"), F.col("k2").alias("e2"))
    earlier = Window.partitionBy("conv").orderBy("block")
    past = earlier.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    ends = ends.select("conv", "block", F.coalesce(F.bit_xor("e1").over(past), zero).alias("e1"), F.coalesce(F.bit_xor("e2").over(past), zero).alias("e2"), F.lead("block").over(earlier).isNull().alias("last_block"))
    return rows.join(ends, ["conv", "block"]).select("conv", "depth", F.col("k1").bitwiseXOR(F.col("e1")).alias("k1"), F.col("k2").bitwiseXOR(F.col("e2")).alias("k2"), "points", (F.col("last_of_block") & F.col("last_block")).alias("last"))


def _shards(rows: DataFrame, level: int, root: dict, bits: int) -> DataFrame:
    """Rows (conv, depth, node, n, ...) of a level's nodes on conversations' paths, with parents and shards.

    ``mark`` is true for a shard's root: the first node of a band of depths or of a power of members.
    """
    step, band = 1 << bits * (level - 1), 1 << bits * level
    depth = F.col("depth")
    own = F.floor(depth / band)
    # the last stretch of a band is shown to the next one, which needs its last node
    bands = F.when(depth % band >= band - step, F.array(own, own + 1)).otherwise(F.array(own))
    path = Window.partitionBy("conv", "band").orderBy("depth")
    power = lambda n: F.floor(F.log2(n) / (bits * level) + 1e-9)
    rows = rows.select("*", F.explode(bands).alias("band"))
    rows = rows.withColumns({
        "parent": F.lag("node", 1, root["node"]).over(path), "parent_depth": F.lag("depth", 1, 0).over(path), "parent_n": F.lag("n", 1, root["n"]).over(path),
    })
    rows = rows.withColumn("mark", (depth % band == 0) | (power(F.col("n")) != power(F.col("parent_n"))))
    top = F.last(F.when(F.col("mark"), F.struct("node", "depth")), ignorenulls=True).over(path.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("top", F.coalesce(top, F.struct(F.lit(root["node"]).alias("node"), F.lit(0).cast("bigint").alias("depth"))))
    return rows.where(own == F.col("band")).withColumn("shard", F.col("top.node")).withColumn("shard_depth", F.col("top.depth")).drop("band", "parent_n", "top")


_VALUES = ["children", "leaves", "saved"]


def _totals(spark: SparkSession, rows: DataFrame, root: dict, bits: int, final: int, level: int = 1) -> DataFrame:
    """Nodes (node, depth, parent, parent_depth, n, children, leaves, saved) with the totals of their whole subtrees.

    ``rows`` has a row for each node on each conversation's path; values are those of the nodes themselves at level 1 and of the shard
    below each node at higher ones.
    """
    top = spark.range(1).select(*[F.lit(root[c]).cast("bigint").alias(c) for c in ("node", "n", *_VALUES)], *[F.lit(v).cast("bigint").alias(c) for c, v in (("depth", 0), ("parent", None), ("parent_depth", None), ("shard_depth", 0))], F.lit(root["node"]).cast("bigint").alias("shard"), F.lit(True).alias("mark"))
    dealt = cut(_shards(rows, level, root, bits))
    nodes = cut(dealt.where("conv = node").drop("conv").unionByName(top))
    if nodes.count() <= final:
        whole = nodes.withColumns({"shard": F.lit(root["node"]).cast("bigint"), "shard_depth": F.lit(0).cast("bigint"), "mark": F.col("depth") == 0})
        return cut(_forward(whole.coalesce(1)))
    sent = cut(_forward(nodes).where("mark").select("node", "depth", *_VALUES))
    above = dealt.where("mark").select("conv", "depth", "node", "n").join(sent, ["node", "depth"])
    ((children, leaves, saved),) = sent.where("depth = 0").select(*_VALUES).collect()
    shards = _totals(spark, above, root | {"children": children, "leaves": leaves, "saved": saved}, bits, final, level + 1)
    arrived = shards.select("node", "depth", *[F.col(c).alias(f"t_{c}") for c in _VALUES])
    links = nodes.where("mark AND depth > 0").select("node", "depth", "parent", "parent_depth")
    messages = links.join(arrived, ["node", "depth"]).groupBy(F.col("parent").alias("node"), F.col("parent_depth").alias("depth"))
    messages = messages.agg(F.count(F.lit(1)).alias("m_children"), F.sum("t_leaves").alias("m_leaves"), F.sum("t_saved").alias("m_saved"))
    filled = nodes.join(messages, ["node", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"m_{c}", F.lit(0)) for c in _VALUES})
    return cut(_forward(filled.drop(*[f"m_{c}" for c in _VALUES])))


def _ends(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256): hash of the sorted ids of the conversations that end at a node, read as a stream."""
    lists = ends.groupBy("node", "depth", F.floor(F.col("conv") / IDS).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ids"))
    ordered = lists.repartition("node", "depth").sortWithinPartitions("node", "depth", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def done(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["node", "depth", "ends_sha256"])

        for batch in batches:
            finished = []
            for node, depth, ids in zip(*(batch.column(n).to_pylist() for n in ("node", "depth", "ids")), strict=True):
                if (node, depth) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    finished.append((*key, state.hexdigest()))
                key, state = (node, depth), hashlib.sha256(ids.encode())
            yield done(finished)
        if key:
            yield done([(*key, state.hexdigest())])

    return ordered.mapInArrow(run, "node bigint, depth bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, bits: int = BITS, final: int = FINAL) -> DataFrame:
    """Every node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` are (conv, place, digest, points) with places from 0 up without gaps, ``convs`` all conversations (conv).
    """
    spark = turns.sparkSession
    paths = cut(_paths(turns))
    keys = ["depth", "k1", "k2"]
    nodes = paths.groupBy(*keys).agg(F.min("conv").alias("node"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("last"), 1)).alias("ends"), F.max("points").alias("points"))
    rows = cut(paths.select("conv", "last", *keys).join(nodes, keys).drop("k1", "k2"))
    smallest, n = convs.agg(F.min("conv"), F.count(F.lit(1))).first()
    silent = convs.join(paths.where("depth = 1").select("conv"), "conv", "left_anti").select("conv", F.lit(smallest).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("depth"))
    root = {"node": smallest, "n": n, "children": 0, "leaves": int(n > 0 and not paths.limit(1).count()), "saved": 0}
    values = rows.select("conv", "depth", "node", "n", F.lit(0).cast("bigint").alias("children"), (F.col("ends") == F.col("n")).cast("bigint").alias("leaves"), ((F.col("n") - 1) * F.col("points")).cast("bigint").alias("saved"))
    totals = _totals(spark, values, root, bits, final).where("node IS NOT NULL")
    ends = _ends(rows.where("last").select("conv", "node", "depth").unionByName(silent))
    nothing = hashlib.sha256(b"").hexdigest()
    return totals.join(ends, ["node", "depth"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The trie of conversations as they are."""
    turns = cut(ranked(conversations, **columns))
    return prefix_trie(turns, turns.where("place = 0").select("conv"))
