import random

import pytest

from veracol.llm.decontamination import Items, banded_edits, drop_leaks, find_leaks, normalised


def edits_anywhere(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def brute(text, items, rate=0.05, q=10):
    text, out = normalised(text or ""), {}
    for i, item in items:
        if item is None or not normalised(item):
            continue
        item = normalised(item)
        if len(item) < q:
            if text == item:
                out[i] = 0
            continue
        k = max(0, min(int(len(item) * rate), (len(item) - q) // q))
        edits = edits_anywhere(item, text)
        if edits <= k:
            out[i] = edits
    return out


def damaged(rng, text, n):
    for _ in range(n):
        at = rng.randrange(len(text) or 1)
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice("xyzé") + text[at:], text[:at] + rng.choice("xyzé") + text[at + 1 :]])
    return text


@pytest.mark.parametrize("alphabet", ["abcdefghij klmnop", "ab", "αβγδ εζ漢"])
def test_like_all_alignments(alphabet):
    rng = random.Random(alphabet)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    items = [(i, word(rng.choice([5, 12, 30, 80, 130]))) for i in range(12)]
    search = Items.build([x for x in items if normalised(x[1])])
    for _ in range(60):
        item = rng.choice(items)[1]
        text = word(rng.randrange(80)) + damaged(rng, item, rng.randrange(0, 9)) + word(rng.randrange(80))
        assert {search.ids[i]: e for i, e in search.find(text).items()} == brute(text, items)


def test_band_alignment_stops():
    assert banded_edits("abcdefghij", "xxabcdefghijyy", 0, 4, 1) == 0
    assert banded_edits("abcdefghij", "xxabcdXfghijyy", 0, 4, 1) == 1
    assert banded_edits("abcdefghij", "nothing of it", 0, 4, 1) == 2


ITEMS = [(1, "The quick brown fox jumps over the lazy dog near the old river bank at noon today."), (1, "The quick brown fox jumps over the lazy dog near the old river bank at noon today."), (2, None), (3, "  "), (4, "short"), (None, "An item without any id whatsoever, yet long enough to be found.")]
DOCS = [(1, "x the QUICK brown\n fox jumps over the lazy dog near the old river bank at noon today. y"), (2, None), (3, ""), (4, "Short"), (5, "a short text"), (None, "see: an item without any id whatsoever, yet long enough to be found. ok"), (6, "quick brown fox jumps over the"), (7, "lorem " * 50000 + ITEMS[0][1] + " ipsum" * 1000), (7, "again " + ITEMS[0][1])]


def test_rows(spark):
    docs = spark.createDataFrame([(*d, 0) for d in DOCS], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(*i, "z") for i in ITEMS], "item_id bigint, text string, doc_id string")
    got = sorted((tuple(r) for r in find_leaks(docs, items).collect()), key=repr)
    assert got == sorted([(1, 1, 0), (4, 4, 0), (None, None, 0), (7, 1, 0), (7, 1, 0)], key=repr)
    assert sorted((tuple(r) for r in find_leaks(docs, items, block_chars=60).collect()), key=repr) == got
    kept = drop_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6]
    assert find_leaks(docs, items.where("false")).count() == 0 and find_leaks(docs.where("false"), items).count() == 0
    assert drop_leaks(docs, items.where("false")).count() == len(DOCS)


def test_given_documents(spark):
    """Every item that stands in a document in so many words is found."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    texts, wanted = [(r.doc_id, normalised(r.text)) for r in docs.collect()], [(r.item_id, normalised(r.text)) for r in items.collect()]
    exact = {(d, i) for d, t in texts for i, p in wanted if p in t}
    got = {(r.doc_id, r.item_id): r.edits for r in find_leaks(docs, items).collect()}
    assert exact and exact == {pair for pair, edits in got.items() if edits == 0}
