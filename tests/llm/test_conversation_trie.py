import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veracol.llm.conversation_trie import MessageQueue, conversation_trie, prefix_trie, ranked, rebuilt

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def sequences(rows):
    """Turns of each conversation in order; ties by the digest of role and text."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            by[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    return {c: [t[3] for t in sorted(v)] for c, v in by.items()}


def begun(paths):
    """As the contract of the query rebuilds them."""
    new = {}
    for c, own in paths.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = paths.get(int(c - (abs(c) % 100) * (1 if c >= 0 else -1)), [])
        new[c] = base[:h] + own[h:]
    return new


def brute(paths):
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    totals = {}
    for p in sorted(members, key=len, reverse=True):  # subtrees bottom up
        below = [totals[k] for k in children[p]]
        saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        totals[p] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    out = set()
    for p, ids in members.items():
        ends = ",".join(str(c) for c in ids if len(paths[c]) == len(p))
        out.add((ids[0], len(p), members[p[:-1]][0] if p else None, len(ids), len(children[p]), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(trie):
    rows = [tuple(r) for r in trie.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def made(seed, n, words=2, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(-3, n):
        for turn in range(rng.randint(0, longest)):
            rows.append((c, turn, rng.choice(["user", "user", None]), rng.choice(["", "é", "hello", None, "a" * 50][: words + 1])))
    return rows


@pytest.mark.parametrize(("bits", "final"), [(6, 50_000), (2, 1), (1, 10)])
def test_like_brute_force(spark, bits, final):
    rows = made(7, 160) + [(500, t, "user", "x") for t in range(90)] + [(501, t, "user", "x" if t < 70 else "y") for t in range(80)]
    turns = ranked(spark.createDataFrame(rows, SCHEMA).repartition(5)).cache()
    plain = prefix_trie(turns, turns.where("place = 0").select("conv"), bits, final)
    assert got(plain) == brute(sequences(rows))
    if bits != 1:
        assert got(prefix_trie(*rebuilt(turns), bits, final)) == brute(begun(sequences(rows)))


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "b"), (1, 2, "user", "a"), (2, None, "", ""), (3, 5, "a", "bc"), (4, 5, "ab", "c"), (5, 0, "u", "w " * 200_000), (6, 0, "u", "w " * 200_000)]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", node int, depth int, conv int")
    assert got(conversation_trie(table)) == brute(sequences(rows))
    assert conversation_trie(table.where("false")).count() == 0
    turns = ranked(table.where("conv_id = 2"))
    assert got(prefix_trie(turns.where("false"), turns.select("conv"))) == brute({2: []})  # a conversation without turns


def test_one_conversation_holds_most_rows(spark):
    rows = [(1, t, "user", "same") for t in range(5000)] + [(2, t, "user", "same") for t in range(4000)] + [(3, 0, "user", "x")]
    trie = conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(6))
    nodes = {(r.conv_id, r.depth): r for r in trie.collect()}
    assert len(nodes) == 5002
    assert nodes[1, 0].saved_tokens == 4000 * 4 and nodes[1, 0].n_leaves == 2 and nodes[1, 0].n_children == 2
    assert nodes[1, 4001].n_convs == 1 and nodes[1, 4000].ends_sha256 == hashlib.sha256(b"2").hexdigest()
    assert nodes[1, 3999].saved_tokens == 2 * 4 and nodes[1, 5000].n_children == 0


def test_queue_spills():
    rng = random.Random(1)
    queue, sums = MessageQueue(limit=10), defaultdict(int)
    for _ in range(500):
        depth, node, value = rng.randint(0, 20), rng.randint(-5, 5), rng.randint(0, 1 << 40)
        queue.push(depth, node, 1, value, -value)
        sums[depth, node] += value
    assert queue.spills > 40
    for depth in range(20, -1, -1):
        for node in range(-5, 6):
            _, a, b = queue.take(depth, node)
            assert a == -b == sums[depth, node]
    assert not queue.heap and not queue.runs


def test_places_are_in_order_without_gaps(spark):
    rows = made(3, 60)
    places = defaultdict(list)
    for r in ranked(spark.createDataFrame(rows, SCHEMA).withColumn("at", F.lit(0))).collect():
        places[r.conv].append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and sum(map(len, places.values())) == len(rows)
