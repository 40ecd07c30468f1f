import random

import numpy as np
import pytest

from veracol.llm import jaccard_dedup, simhash_dedup
from veracol.llm.jaccard_dedup import drop_near_duplicates


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """Ids kept when all pairs are compared; rows have different ids."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if root[i] != root[j] and (not a and not b or a and b and 5 * len(a & b) >= 4 * len(a | b)):
                root = [root[j] if r == root[i] else r for r in root]
    best = {}
    for r, (i, _) in zip(root, rows, strict=True):
        best[r] = min(best.get(r, i), i)
    return sorted(best.values())


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize("small", [12, 2])
def test_near_copies_like_brute_force(spark, monkeypatch, small):
    """Copies with 0 to 8 of 120 words changed (similarity 1 to about 0.5), and chains of them, in buckets small and large."""
    monkeypatch.setattr(jaccard_dedup, "SMALL_BUCKET", small)
    rng = random.Random(3)
    rows = [(0, None), (1, " \n"), (2, "a b c"), (3, "A  b C"), (4, "a b")]
    for _ in range(30):
        words = [f"w{rng.randrange(4000)}" for _ in range(120)]
        for _ in range(rng.choice([1, 2, 6])):
            rows.append((len(rows), edited(rng, words, rng.randrange(9))))
    chain = [f"c{i}" for i in range(120)]
    for _ in range(40):
        chain = edited(rng, chain, 2).split(" ")
        rows.append((len(rows), " ".join(chain)))
    rng.shuffle(rows)
    got = sorted(r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect())
    assert got == brute_kept(rows)


def _candidates_of(spark, n):
    """Candidate pairs of a group of n near copies, both rounds."""
    rng = random.Random(n)
    words = [f"w{rng.randrange(9000)}" for _ in range(200)]
    rows = [(i, edited(rng, words, rng.randrange(4))) for i in range(n)]  # up to 6 edits apart, all in one group
    made = []
    kept = jaccard_dedup._verified

    def counted(pairs, sets):
        made.append(pairs.count())
        return kept(pairs, sets)

    jaccard_dedup._verified = counted
    try:
        left = drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).count()
    finally:
        jaccard_dedup._verified = kept
    return sum(made), left


def test_candidates_grow_with_the_group(spark):
    few, _ = _candidates_of(spark, 400)
    many, left = _candidates_of(spark, 2000)
    assert many < 8 * few and left == 1, (few, many, left)


def test_columns_with_the_names_used_inside(spark):
    rows = [(1, "a b c d e f", "mine", "k", 7, 8), (2, "a b c d e f", "other", "k", 7, 9), (3, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _words string, _k1 string, `__k2` int, root int")
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    kept = {r.doc_id for r in drop_near_duplicates(docs).collect()}
    assert sorted(kept) == want
    assert not {770, 944, 875, 255} & kept  # over 4 bits from their originals


def test_pairs_at_the_limit_share_a_band():
    rng = np.random.default_rng(1)
    for _ in range(300):
        words = rng.integers(0, 1 << 64, 250, dtype=np.uint64)
        a, b = jaccard_dedup.minima(words[:225]), jaccard_dedup.minima(words[25:])  # 200 of 250
        assert (jaccard_dedup.band_keys(a[None]) == jaccard_dedup.band_keys(b[None])).any() and (a == b).sum() >= jaccard_dedup.LEAST_ALIKE


def _verified_pairs(monkeypatch):
    """Counts of the pairs that go into the verifying join, filled as it is used."""
    made, kept = [], jaccard_dedup._verified

    def counted(pairs, sets):
        made.append(pairs.count())
        return kept(pairs, sets)

    monkeypatch.setattr(jaccard_dedup, "_verified", counted)
    return made


def _almost_alike(n):
    """n short texts, each one or two words off the same one: most pairs are at 0.55 to 0.8, some above."""
    rng = random.Random(n)
    words = [f"w{i}" for i in range(40)]
    return [(i, edited(rng, words, rng.choice([1, 1, 2]))) for i in range(n)]


@pytest.mark.parametrize("block", [2048, 16])
def test_almost_alike_texts_are_verified_in_their_buckets(spark, monkeypatch, block):
    """The join takes pairs in proportion to the group, though all pairs of the group look alike; buckets may be dealt in blocks."""
    monkeypatch.setattr(jaccard_dedup, "BLOCK", block)
    made, sums = _verified_pairs(monkeypatch), []
    for n in (150, 450):
        rows = _almost_alike(n)
        got = sorted(r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect())
        assert got == brute_kept(rows)
        sums.append(sum(made))
        made.clear()
    assert sums[1] < 6 * sums[0] and sums[1] < 10 * 450, sums


def test_pairs_whose_bytes_agree_in_a_band_they_do_not_share(spark):
    """One byte of each minimum may agree by chance; such a pair still counts in the bands it does share."""
    rng, found = random.Random(11), 0
    rows = []
    while found < 4:
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        pair = [" ".join(words), edited(rng, words, 1)]
        least = np.array([jaccard_dedup.minima(jaccard_dedup.shingles(t.encode())) for t in pair])
        keys, sketch = jaccard_dedup.band_keys(least), ((least * jaccard_dedup._MIX) >> np.uint64(56)).astype(np.uint8)
        bytes_agree = (sketch[0].reshape(-1, 4) == sketch[1].reshape(-1, 4)).all(axis=1)
        if bytes_agree.argmax() < (keys[0] == keys[1]).argmax():
            rows += [(len(rows), pair[0]), (len(rows) + 1, pair[1])]
            found += 1
    assert len(brute_kept(rows)) == found
    kept = drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)


def test_fingerprints_within_four_bits_are_candidates(spark, monkeypatch):
    """The links of op1's method are among the candidates and are verified on the shingles."""

    def none():
        return lambda batches: iter(())

    monkeypatch.setattr(jaccard_dedup, "_candidates", none)
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "last"]), " ".join(["first", *words[1:]]), "a b c d e f", "other words stand in this one"]
    prints = [simhash_dedup.majority(jaccard_dedup.shingles(t.encode())) for t in texts]
    assert max((prints[0] ^ p).bit_count() for p in prints[1:3]) <= simhash_dedup.MAX_BITS
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == [0, 3, 4]
