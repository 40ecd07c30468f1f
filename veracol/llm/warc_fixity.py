"""Fixity audit of archive replicas with Merkle trees over their records.

Pages become archive records: a header and the page's bytes. Records of an archive lie one behind the
other in the order of their keys; each has an offset range and the SHA-256 of its bytes. Every replica is laid out by itself.

A record's key does not depend on the others: its id and the number of its occurrence among the
records of that id. A leaf of the tree covers one id, a node above it ``FAN`` consecutive ids, then ``FAN`` such
ranges, and with them a range of offsets; its hash is that of its children's places and hashes. So a lost or an extra record
changes the hashes above its own id only, though it moves the offsets of all that follow. Offsets are reported, not compared.

An audit compares the replicas' roots, then joins only the children of nodes that differ, level by
level, down to the ids and their records. Whole archives that agree cost one row.

Archives hold ``RECORDS`` consecutive ids. Rows with a null id are dealt by their content into
archives of their own (far below those of negative ids) and into places there.

Records of one id are matched by content first: equal ones are the same record, however often they repeat, and
only what is left over on both sides is paired, in the order of digests, as corrupt; the rest is missing or extra. Copies of a record are one row
with their number until they differ. No step gathers an id or an archive: running sums go by parts of a digest first. Records with a
null id have nothing but their content, so a changed one is missing and its change extra. Null addresses and pages are empty, empty tables
agree with each other, long pages are hashed whole by Spark, and other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import cut

FAN = 16
RECORDS = 1024
LOOSE_ARCHIVES = 4096
LOOSE_PLACES = 1 << 30
_BATCH = 4096


def record_bytes(page_id: str = "page_id", url: str = "url", html: str = "html") -> Column:
    """A page as the text of one response record."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), empty(page_id), F.lit(">\r\nWARC-Target-URI: "), empty(url), F.lit("\r\nContent-Length: "))
    return F.concat(head, F.octet_length(empty(html)).cast("string"), F.lit("\r\n\r\n"), empty(html), F.lit("\r\n\r\n"))


def archive_number(page_id: str = "page_id") -> Column:
    whole = F.col(page_id).cast("bigint")
    return F.coalesce(F.floor((whole - F.pmod(whole, F.lit(RECORDS))) / RECORDS), F.lit(-(1 << 62)) - F.pmod(F.xxhash64("digest"), F.lit(LOOSE_ARCHIVES)))


def _before(rows: DataFrame, keys: list[str], finer: list[str], weight: Column, name: str) -> DataFrame:
    """Add the sum of ``weight`` over the rows of a key before each in the order (finer, digest): over parts first, then within each part."""
    part = [*keys, *finer, "part"]
    rows = rows.withColumn("part", F.substring("digest", 1, 3))
    ahead = F.sum("whole").over(Window.partitionBy(*keys).orderBy(*finer, "part").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy(*part).agg(F.sum(weight).alias("whole")).select(*part, F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = F.sum(weight).over(Window.partitionBy(*part).orderBy("digest").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, part).withColumn(name, F.col("ahead") + F.col("inside")).drop("part", "ahead", "inside")


def lay_out(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(archive, place, page_id, start, stop, digest, copies): where each record lies. Pages themselves do not move.

    ``place`` is the id's within its archive; records of one id share it. ``copies`` equal records lie one behind the other
    from start to stop.
    """
    record = record_bytes(page_id, url, html)
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.octet_length(record).cast("bigint").alias("size"), F.sha2(record, 256).alias("digest"))
    rows = rows.withColumn("archive", archive_number("page_id").cast("bigint"))
    loose = F.pmod(F.xxhash64(F.lit(1), "digest"), F.lit(LOOSE_PLACES))
    rows = rows.withColumn("place", F.coalesce(F.pmod("page_id", F.lit(RECORDS)), loose).cast("bigint"))
    kinds = rows.groupBy("archive", "place", "page_id", "digest", "size").agg(F.count(F.lit(1)).alias("copies"))
    placed = _before(kinds, ["archive"], ["place"], F.col("copies") * F.col("size"), "start")
    return placed.select("archive", "place", "page_id", "start", (F.col("start") + F.col("copies") * F.col("size")).alias("stop"), "digest", "copies")


def _leaves(records: DataFrame) -> DataFrame:
    """(archive, place, start, stop, digest) of each id: the hash of its records' digests and their numbers."""
    # sums of four parts of a digest do not depend on order, so an id with very many different records needs no list of them
    part = lambda i: F.sum(F.conv(F.substring(F.sha2(F.concat_ws(":", "digest", "copies"), 256), 1 + 15 * i, 15), 16, 10).cast("decimal(28,0)"))
    mixed = F.sha2(F.concat_ws(",", *[part(i).cast("string") for i in range(4)]), 256)
    return records.groupBy("archive", "place").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), mixed.alias("digest"))


def merkle_levels(records: DataFrame, levels: int, fan: int = FAN) -> list[DataFrame]:
    """Nodes (archive, place, start, stop, digest) of every level, ids first, roots last."""
    out = [cut(_leaves(records))]
    for _ in range(levels):
        children = F.array_sort(F.collect_list(F.struct("place", "digest")))  # at most ``fan``
        whole = F.array_join(F.transform(children, lambda c: F.concat(c["place"].cast("string"), F.lit(":"), c["digest"])), ",")
        below = out[-1].groupBy("archive", F.floor(F.col("place") / fan).cast("bigint").alias("up")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sha2(whole, 256).alias("digest"))
        out.append(cut(below.withColumnRenamed("up", "place")))
    return out


def tree_height(records: DataFrame, fan: int = FAN) -> int:
    """Levels above the ids that bring every archive to one root."""
    last, height = records.agg(F.max("place")).first()[0] or 0, 1
    while last >= fan:
        last, height = last // fan, height + 1
    return height


def _singles(rows: DataFrame, count: str, name: str) -> DataFrame:
    """Each row ``count`` times, numbered from 0, in two steps so that no long list arises."""
    rows = rows.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(count) - 1) / _BATCH))))
    last = F.least(F.col("batch") * _BATCH + _BATCH, F.col(count)) - 1
    return rows.withColumn(name, F.explode(F.sequence(F.col("batch") * _BATCH, last))).drop("batch")


def _unmatched(expected: DataFrame, found: DataFrame, places: DataFrame) -> DataFrame:
    """Records of the given places that the other replica does not have, paired in their order: (archive, place, expected, found)."""
    key = ["archive", "place"]
    sides = [records.join(places, key, "left_semi").withColumn("side", F.lit(sign)) for records, sign in ((expected, 1), (found, -1))]
    of_side = lambda sign: F.max(F.when(F.col("side") == sign, F.struct("start", "stop", "copies")))
    kinds = sides[0].unionByName(sides[1]).groupBy(*key, "page_id", "digest").agg(F.sum(F.col("side") * F.col("copies")).alias("more"), of_side(1).alias("left"), of_side(-1).alias("right"))
    kinds = kinds.where("more <> 0").withColumn("side", F.signum("more").cast("int")).withColumn("n", F.abs("more")).withColumn("of", F.when(F.col("more") > 0, F.col("left")).otherwise(F.col("right")))
    # the last copies are those the other side lacks
    kinds = kinds.withColumn("size", F.floor((F.col("of.stop") - F.col("of.start")) / F.col("of.copies"))).withColumn("first", F.col("of.stop") - F.col("n") * F.col("size"))
    ranked = _before(kinds.select(*key, "side", "page_id", "digest", "n", "size", "first"), [*key, "side"], [], F.col("n"), "rank")
    single = cut(_singles(ranked, "n", "i"))
    start = F.col("first") + F.col("i") * F.col("size")
    nth = F.when(F.col("page_id").isNotNull(), F.col("rank") + F.col("i")).alias("nth")  # without an id nothing is paired
    one = lambda sign, name: single.where(F.col("side") == sign).select(*key, nth, F.struct("page_id", start.alias("start"), (start + F.col("size")).alias("stop"), "digest").alias(name))
    return one(1, "expected").join(one(-1, "found"), [*key, "nth"], "full_outer")


def audit(expected: DataFrame, found: DataFrame, fan: int = FAN) -> DataFrame:
    """Records that differ between two replicas: (archive, place, page_id, start, stop, status, expected, found), each once.

    Offsets are those of the expected replica, or of the found one for a record only it has. ``status``
    is corrupt, missing or extra.
    """
    expected, found = cut(expected), cut(found)
    height = max(tree_height(expected, fan), tree_height(found, fan))
    left, right = merkle_levels(expected, height, fan), merkle_levels(found, height, fan)
    differing = None
    for level in range(height, -1, -1):
        sides = []
        for nodes, name in ((left[level], "expected"), (right[level], "found")):
            if differing is not None:
                parent = F.floor(F.col("place") / fan).cast("bigint")
                nodes = nodes.withColumn("up", parent).join(differing.select("archive", F.col("place").alias("up")), ["archive", "up"], "left_semi")
            sides.append(nodes.select("archive", "place", F.col("digest").alias(name)))
        both = sides[0].join(sides[1], ["archive", "place"], "full_outer")
        differing = cut(both.where(~F.col("expected").eqNullSafe(F.col("found"))).select("archive", "place"))
    pairs = _unmatched(expected, found, differing)
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("corrupt")
    at = lambda field: F.coalesce(F.col(f"expected.{field}"), F.col(f"found.{field}")).alias(field)
    return pairs.select("archive", "place", at("page_id"), at("start"), at("stop"), status.alias("status"), F.col("expected.digest").alias("expected"), F.col("found.digest").alias("found"))
