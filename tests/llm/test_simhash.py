import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veracol.llm.shared import connected
from veracol.llm.simhash_dedup import _golay_tables, drop_near_duplicates, fingerprint, golay_keys, near_links, simhash_components


def brute_components(ids, prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    words = np.array(prints, dtype=np.uint64)
    for i in range(len(words)):
        for j in np.flatnonzero(np.bitwise_count(words[i] ^ words[i + 1 :]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(len(prints))]
    best = {}
    for i, r in enumerate(roots):
        if ids[i] is not None:
            best[r] = min(best.get(r, ids[i]), ids[i])
    return [best.get(r) for r in roots]


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "a b c", "A b\tC d", "a b c d e f g É Ü x\x0by", "w " * 9000])
def test_fingerprint(text):
    assert fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_shared_keys_within_four_bits():
    """Every pair within 4 bits shares a key, for random words and random flips."""
    rng, tables = np.random.default_rng(5), _golay_tables()
    words = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    near = words.copy()
    for i in range(len(near)):
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(bit)
    keys = {}
    for key, word in zip(*golay_keys(words, tables), strict=True):
        keys.setdefault(int(word), set()).add(int(key))
    other = {}
    for key, word in zip(*golay_keys(near, tables), strict=True):
        other.setdefault(int(word), set()).add(int(key))
    assert all(keys[int(a)] & other[int(b)] for a, b in zip(words, near, strict=True))


@pytest.mark.parametrize("hot", [20_000, 30])
def test_links_connect_like_brute_force(spark, hot):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 64, 12, dtype=np.uint64)
    words = set(rng.integers(0, 1 << 64, 300, dtype=np.uint64).tolist()) | {0}
    for c in centres.tolist():
        for _ in range(60):
            word = c
            for bit in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                word ^= 1 << bit
            words.add(word)
    words = sorted(words)
    df = spark.createDataFrame([(int(np.uint64(w).view(np.int64)),) for w in words], "fp bigint")
    roots = {r.node: r.root for r in connected(near_links(df, hot=hot)).collect()}
    want = brute_components(list(range(len(words))), words)
    signed = [int(np.uint64(w).view(np.int64)) for w in words]
    got = [roots.get(w, w) for w in signed]
    pairs = set(zip(want, got, strict=True))
    assert len(pairs) == len(set(want)) == len(set(got))


ROWS = [(5, "one two three four five"), (3, "ONE two three four five"), (None, None), (9, ""), (3, "one two three four five"), (8, "x"), (8, "x"), (None, "alone here"), (None, "alone here"), (11, "long " * 40000)]


def test_components_and_edge_rows(spark):
    docs = spark.createDataFrame([(*r, "extra", 1) for r in ROWS], "doc_id bigint, text string, fp string, component_id int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(docs).collect()), key=repr)
    prints = [plain_fingerprint(t) for _, t in ROWS]
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(ROWS, prints, brute_components([i for i, _ in ROWS], prints), strict=True)), key=repr)
    assert got == want


def test_one_of_each_group_stays(spark):
    docs = spark.createDataFrame([(*r, "extra") for r in ROWS], "doc_id bigint, text string, root string")
    got = sorted([(r.doc_id, r.text) for r in drop_near_duplicates(docs).collect()], key=repr)
    assert [g for g in got if g[0] == 3] and len([g for g in got if g[0] == 3]) == 1
    assert sorted([g[0] for g in got], key=repr) == sorted([3, 9, 8, None, 11], key=repr)
    assert drop_near_duplicates(docs).columns == docs.columns
    assert drop_near_duplicates(docs.where("false")).count() == 0
    assert simhash_components(docs.where("false")).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [fingerprint((r.text or "").encode()) for r in rows]
    want = dict(zip([r.doc_id for r in rows], brute_components([r.doc_id for r in rows], prints), strict=True))
    got = {r.doc_id: r.component_id for r in simhash_components(docs.select("doc_id", "text", F.lit(1).alias("key"))).collect()}
    assert got == want and len(set(want.values())) < len(want)
