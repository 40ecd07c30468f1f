"""Conversations in reply order, linked by what their messages quote. DataFrame functions only.

A message's lines may start with quote marks (``>``, with blanks between); their number is the line's
level. Lines are compared without marks, in lower case with white space collapsed, by a 128-bit hash.
Lines of level 0 are a message's own. A quoted line comes from the latest earlier message of the
conversation whose own line it is; a message replies to the message that most of its lines of level
1 come from, the later one among equals. Replies form trees: a message without a link opens a
thread; ``thread`` is the turn that opened it, ``depth`` the number of replies down to the message,
``position`` its place in the thread (after its parent), and ``text`` what remains without quoted lines.

Looking back within one line of one conversation is done in blocks of turns and then over blocks, so
neither a very long conversation nor a very common line is one task's work. Rows with a null
conversation or turn keep their text and open threads of their own. Repeated rows share their links;
each is returned, numbered by its text. Null texts have no lines and stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import cut

BLOCK = 4096
MARKS = r"^[ \t]?(?:>[ \t]?)+"


def level(line: Column) -> Column:
    """Number of quote marks that a line starts with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def line_hash(line: Column) -> Column:
    """Hash of a line without marks, lower-case, with white space collapsed; null for a blank one."""
    plain = F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"\s+", " "))
    return F.when(plain != "", F.unhex(F.md5(plain)))


def unquoted(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: level(line) == 0), "\n")


def _origins(lines: DataFrame) -> DataFrame:
    """Quoted lines (conv, turn, level, origin): the latest earlier turn that has the line as its own."""
    own = lines.where("level = 0").select("conv", "turn", "hash").distinct()
    rows = own.select("conv", "hash", "turn", F.col("turn").alias("said"), F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("n"))
    quoted = lines.where("level > 0").groupBy("conv", "hash", "turn", "level").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.unionByName(quoted.withColumn("said", F.lit(None).cast("bigint"))).withColumn("block", F.floor(F.col("turn") / BLOCK))
    rows = cut(rows)
    within = Window.partitionBy("conv", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max("said").over(within)).where("level > 0")
    blocks = rows.groupBy("conv", "hash", "block").agg(F.max("said").alias("last"))
    before = Window.partitionBy("conv", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("far", F.max("last").over(before)).select("conv", "hash", "block", "far")
    return near.join(carried, ["conv", "hash", "block"]).select("conv", "turn", "level", "n", F.coalesce("near", "far").alias("origin"))


def _threads(parents: DataFrame) -> DataFrame:
    """(conv, turn, thread, depth) of every message with a parent: ancestors are doubled until all are roots."""
    reach = cut(parents.select("conv", "turn", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("steps")))
    while True:
        further = reach.select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("more"))
        grown = reach.join(further, ["conv", "up"], "left")
        moved = cut(grown.select("conv", "turn", F.coalesce("up2", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("up2").isNotNull().alias("moved")))
        if not moved.where("moved").limit(1).count():
            return moved.select("conv", "turn", F.col("up").alias("thread"), F.col("steps").alias("depth"))
        reach = moved.select("conv", "turn", "up", "steps")


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, thread, position, depth, parent_turn, n_quoted, n_linked, levels, text) of every message."""
    named = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"), F.col(text).cast("string").alias("body"))
    lines = named.where("conv IS NOT NULL AND turn IS NOT NULL").select("conv", "turn", F.explode(F.split("body", "\n")).alias("line"))
    lines = lines.select("conv", "turn", level(F.col("line")).alias("level"), line_hash(F.col("line")).alias("hash")).where("hash IS NOT NULL")
    origins = cut(_origins(lines))
    facts = origins.groupBy("conv", "turn").agg(F.sum("n").alias("n_quoted"), F.coalesce(F.sum(F.when(F.col("origin").isNotNull(), F.col("n"))), F.lit(0)).alias("n_linked"), F.max("level").alias("levels"))
    votes = origins.where("level = 1 AND origin IS NOT NULL").groupBy("conv", "turn", "origin").agg(F.sum("n").alias("n"))
    parents = cut(votes.groupBy("conv", "turn").agg(F.max(F.struct("n", "origin")).alias("best")).select("conv", "turn", F.col("best.origin").alias("parent")))
    found = facts.join(parents, ["conv", "turn"], "left").join(_threads(parents), ["conv", "turn"], "left")
    rows = named.join(found, ["conv", "turn"], "left").withColumn("thread", F.coalesce("thread", "turn")).withColumn("block", F.floor(F.col("turn") / BLOCK))
    tie = [F.col("turn"), F.md5(F.coalesce("body", F.lit(""))), F.col("role")]
    loose = F.when(F.col("conv").isNull() | F.col("turn").isNull(), F.xxhash64("body", "role", "turn", "conv"))
    place = F.row_number().over(Window.partitionBy("conv", "thread", "block", loose).orderBy(*tie)).cast("bigint")
    rows = cut(rows.withColumn("place", place))
    counts = rows.where(loose.isNull()).groupBy("conv", "thread", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv", "thread").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("conv", "thread", "block", earlier.alias("earlier"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return rows.join(counts, ["conv", "thread", "block"], "left").select(
        F.col("conv").alias("conv_id"), "turn", "role", "thread", (F.col("place") + zero("earlier")).alias("position"), zero("depth").alias("depth"), F.col("parent").alias("parent_turn"),
        zero("n_quoted").alias("n_quoted"), zero("n_linked").alias("n_linked"), zero("levels").alias("levels"), unquoted(F.col("body")).alias("text"),
    )
