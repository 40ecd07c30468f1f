import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veracol.llm import token_files
from veracol.llm.piece_codec import MARK, Codec, StreamingViterbi, Vocabulary, encode_documents
from veracol.llm.token_files import SequenceFile, WordCache, file_bytes, round_trip

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ROWS = [(5, "Hello world, it's  5 o'clock"), (2, None), (1, ""), (None, "no id"), (None, "another"), (3, "same"), (3, "same"), (3, "other"), (9, "x" * 5000 + " ## #  ÀÉ é 漢字 <|endoftext|> ΑΣ"), (7, " \n\t "), (8, "word " * 20000)]


def checksum(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def expected(rows):
    tokenizer = Tokenizer.from_file(WORDS)
    out, start = [], 0
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), checksum(ids)))
        start += len(ids)
    return out


@pytest.mark.parametrize("file_tokens", [1 << 23, 50])
def test_files_like_the_library(spark, file_tokens):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id bigint, text string, n_tokens int").repartition(3)
    got = sorted((tuple(r) for r in round_trip(docs, WORDS, 2, file_tokens=file_tokens).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([r[0] for r in ROWS], key=lambda i: (i is not None, i))
    ends = [r[1] + r[2] for r in got]
    assert [r[1] for r in got] == [0, *ends[:-1]]
    drop_start = lambda rows: sorted(((r[0], r[2], r[3]) for r in rows), key=repr)
    assert drop_start(got) == drop_start(expected(ROWS))
    assert round_trip(docs.where("false"), WORDS, 2).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in round_trip(docs, WORDS, 2).collect()) == expected(rows)


def test_random_access_without_copies(tmp_path):
    ids = np.arange(1, 2500, dtype=np.uint16)
    index = pa.RecordBatch.from_pydict({"doc_id": [1], "n_tokens": [len(ids)]})
    path = str(tmp_path / "a.arrow")
    with open(path, "wb") as out:
        out.write(file_bytes(ids, index, sequence=8))
    file = SequenceFile(path)
    assert len(file) == 313 and file.n_tokens == len(ids)
    for i in (0, 7, 255, 256, 300):
        view = file.ids(i)
        assert not view.flags.owndata and view.tolist() == ids[8 * i : 8 * i + 8].tolist()
        assert file.mask(i).to_pylist() == [True] * 8
    assert file.mask(312).to_pylist() == [True] * 3 + [False] * 5
    assert file.tokens(2040, 2060).tolist() == ids[2040:2060].tolist()


def full_search(text, v):
    """Plain Viterbi over the whole text: the best sum."""
    best = [0.0] + [-np.inf] * len(text)
    for start in range(len(text)):
        if text[start] not in v.pieces:
            best[start + 1] = max(best[start + 1], best[start] + v.unknown)
        for end in range(start + 1, min(len(text), start + v.longest) + 1):
            if text[start:end] in v.pieces:
                best[end] = max(best[end], best[start] + v.pieces[text[start:end]][0])
    return best[-1]


def sum_of(ids, v):
    by_id = {i: s for s, i in v.pieces.values()}
    bytes_ = set(v.bytes)
    data, total = b"", 0.0
    for i in [*ids, None]:
        if i in bytes_:
            data += bytes([v.bytes.index(i)])
        else:
            total, data = total + v.unknown * len(data.decode("utf-8", "replace")), b""
            total += by_id.get(i, 0.0)
    return total


def test_streaming_search_is_best():
    v, rng = Vocabulary(PIECES), random.Random(1)
    codec = Codec(PIECES)
    alphabet = "abcdefghi thenr  \n\t\r{};é漢界日本語🙂"
    for n in [*range(1, 60), 400, 3000]:
        text = "".join(rng.choice(alphabet) for _ in range(n))
        plain = MARK + text.replace(" ", MARK)
        search = StreamingViterbi(v)
        ids = [*search.feed(plain), *search.finish()]
        assert sum_of(ids, v) == full_search(plain, v)
        assert sum_of(codec.encode(text), v) == full_search(plain, v)
        assert codec.decode(codec.encode(text)) == text
        if n == 3000:
            assert search.commits > 20 and search.widest < 600


def test_like_the_librarys_search_over_the_pieces(tmp_path):
    """The same model file marked as one to be searched gives the same pieces."""
    raw = open(PIECES, "rb").read()
    # fixed values: field 3 (model type) of the trainer settings is 2 for merges and 1 for search
    at = raw.rindex(b"tok_v0\x18\x02") + 7
    path = tmp_path / "search.model"
    path.write_bytes(raw[:at] + b"\x01" + raw[at + 1 :])
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    codec = Codec(PIECES)
    for text in ["Hello world", "The quick brown fox jumps over the lazy dog", "Eauouon enpaeux leaux le", "a  b   c", "internationalization of things", "zzzqqq xx"]:
        assert list(codec.encode(text)) == library.encode(text)


def test_documents(spark):
    docs = spark.createDataFrame([(*r, 1) for r in [*ROWS, (20, "a ▁ b")]], "doc_id bigint, text string, ids int")
    rows = encode_documents(docs, PIECES, ["doc_id"]).collect()
    codec = Codec(PIECES)
    got = sorted([(r.doc_id, codec.decode(r.ids), r.n_pieces, r.ids_crc32, r.same_text) for r in rows], key=repr)
    want = [(i, (t or "").replace(MARK, " "), len(codec.encode(t or "")), checksum(codec.encode(t or "")), True) for i, t in [*ROWS, (20, "a ▁ b")]]
    assert got == sorted(want, key=repr)
    assert encode_documents(docs.where("false"), PIECES, ["doc_id"]).count() == 0


def test_all_given_documents_come_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert encode_documents(docs, PIECES, ["doc_id", "source"]).where("not same_text").count() == 0


def test_marks_that_compose_in_lower_case_only():
    """The library composes before it drops case, so J with a caron stays two characters and j does not."""
    words = [f"{letter}{mark}ab" for letter, mark in zip("JHTWY", "\u030c\u0331\u0308\u030a\u030a", strict=True)]
    texts = [*words, *(w.lower() for w in words), "Plain WORDS. " + " ".join(words) + " É, ÉCOLE. <", "<|endoftext|> " + words[0]]
    tokenizer = Tokenizer.from_file(WORDS)
    got = [np.frombuffer(ids, "<u2").tolist() for ids in WordCache(WORDS, "H").encode([t.encode() for t in texts])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_codec_beside_columns_of_its_own_names(spark, tmp_path):
    """Given columns stay as they are; new ones move aside, and the rows can be written."""
    docs = spark.createDataFrame([(1, "a cat", "mine", 7, True), (2, None, None, None, None)], "doc_id bigint, text string, IDS string, n_pieces int, _n_pieces boolean")
    out = encode_documents(docs, PIECES, docs.columns)
    assert out.columns == [*docs.columns, "_ids", "__n_pieces", "ids_crc32", "same_text"]
    out.write.parquet(f"{tmp_path}/out")
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert (rows[1]["IDS"], rows[1]["n_pieces"], rows[1]["_n_pieces"], rows[1]["same_text"]) == ("mine", 7, True, True)
    assert len(rows[1]["_ids"]) == rows[1]["__n_pieces"] > 0 and rows[2]["_ids"] == [] and rows[2]["IDS"] is None


def _odd_texts(n, seed):
    """Texts of letters, digits, marks and blanks of several scripts, most of them Latin-1, put together at random."""
    rng = random.Random(seed)
    latin = ["a", "B", "th", "É", "é", "ñ", "ß", "×", "÷", "º", "²", "µ", "7", "42", "'s", "'", "'ll", ".", ",", "...", "$$$", "#", "%", "-", "_", "|", "<", ">", "<|", " ", " ", " ", "  ", "\n", "\t", "\u00a0", "\u0085", "\x0b", "\x00"]
    wide = [*latin, "\u0338", "\u0301", "\u030c", "Σ", "İ", "漢", "🙂", "ﬁ", "<|endoftext|>", "\u2028"]
    return ["".join(rng.choices(latin if i % 3 else wide, k=rng.randrange(40))) for i in range(n)]


@pytest.mark.parametrize("cached", [400_000, 50])
def test_word_cache_on_odd_texts(monkeypatch, cached):
    monkeypatch.setattr(token_files, "_CACHED", cached)
    texts, tokenizer, cache = _odd_texts(3000, 4), Tokenizer.from_file(WORDS), WordCache(WORDS, "H")
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        got = [np.frombuffer(ids, "<u2").tolist() for ids in cache.encode([t.encode() for t in part])]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]


def test_word_cache_encodes_a_word_once():
    """Case, and marks at the end of a word, make no new words for the tokenizer."""
    cache, asked = WordCache(WORDS, "H"), []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, words, **options):
            asked.extend(words)
            return self.tokenizer.encode_batch_fast(words, **options)

    cache.tokenizer = Counted(cache.tokenizer)
    list(cache.encode(["Canción canción, CANCIÓN. canción$$$ Word word, WORD$$$ word...".encode()]))
    assert sorted(asked) == sorted(["canción", "word", ",", ".", "$$$", "..."])


def test_places_that_no_piece_crosses():
    """Cut parts and whole ones give the ids of one search over the text."""
    codec = Codec(PIECES)
    v = codec.vocabulary
    assert any("s%" == p[i : i + 2] for p in v.pieces for i in range(len(p))) == ("s%" in v.pairs)
    for text in [*_odd_texts(600, 8), "12 345 thing%%% ABC Éan x9y", "ñas%%% er### " * 5]:
        plain = MARK + text.replace(" ", MARK)
        search = StreamingViterbi(v)
        assert list(codec.encode(text)) == ([*search.feed(plain), *search.finish()] if text else [])
        assert codec.decode(codec.encode(text)) == text
    searched = []

    class Counted(StreamingViterbi):
        def feed(self, part):
            searched.append(part)
            return super().feed(part)

    codec._encode_part("thing%%%", Counted(v))
    assert searched and max(map(len, searched)) < len("thing%%%")


def test_bytes_that_are_no_characters_decode_as_before():
    codec = Codec(PIECES)
    b, (letter,) = codec.vocabulary.bytes, [i for p, (_, i) in codec.vocabulary.pieces.items() if p == "é"]
    assert codec.decode([b[0xE6], b[0xBC], letter, b[0xFF], b[0xE6], b[0xBC], b[0xA2]]) == "\ufffdé\ufffd漢"


def test_sums_are_final_as_characters_come():
    """The automaton needs no view of the characters that follow, and longer pieces win ties as before."""
    v, search, text = Vocabulary(PIECES), StreamingViterbi(Vocabulary(PIECES)), MARK + "therein▁▁naïvely 漢字🙂x\n\n\n%%%.;Internationalé"
    for n, c in enumerate(text, 1):
        search.read(c)
        assert search.best[n] == full_search(text[:n], v)
    assert sum_of(search.finish(), v) == full_search(text, v)


def test_full_cache_keeps_its_newer_half(monkeypatch):
    """Words are searched once, a long one once for each text, and a full cache is not emptied."""
    monkeypatch.setattr("veracol.llm.piece_codec._CACHED", 50)
    codec, plain, words = Codec(PIECES), Codec(PIECES), [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    for at, word in enumerate(words):
        assert codec.encode(word) == plain.encode(word)
        assert all(MARK + w in codec.known for w in words[max(0, at - 20) : at])
        assert len(codec.known) <= 51
        plain.forget()
    asked, search = [], codec.search
    monkeypatch.setattr(search, "feed", lambda part, feed=search.feed: (asked.append(part), feed(part))[1])
    long = "abc" * 40
    codec.encode(f"{long} {long} new, new; new {long}")
    assert sorted(asked) == sorted([MARK + long, MARK + "new", ",", ";"]) and MARK + long not in codec.known
