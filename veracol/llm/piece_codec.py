"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The search takes the pieces of a model file with their scores and finds the segmentation with the
greatest sum. It reads characters as a stream through an automaton whose states name the pieces that end
at a character, the longest first, so a position's best sum is final once its character is read. Back
pointers are kept only from the last commit on: pieces yet to end can start at the last characters that
begin some piece, so when the paths from all of those positions meet in one boundary, every best path
passes through it and the ids before it are final.

A character that no piece covers costs the least score less 10 and becomes byte pieces. As in the file's
normaliser a blank becomes the piece mark and one is put in front. Texts hold the mark itself rarely; it
decodes to a blank. Where no piece has a mark after another character, none holds some ASCII
character together with others, or none holds the two characters at an edge of a word next to each other, all paths converge
by the vocabulary alone; the stretches between such places are looked up once and kept in a bounded cache, whose
older half is dropped when it is full. Files whose ids were made by merges (as the 32k one) give other ids with the
library's own merge encoder; sums are compared with the library's search over the same pieces in the tests.

Null and empty texts have no pieces. Repeated rows and null ids each give their row.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import text_bytes

MARK = "▁"
CHECK_EVERY = 32
_CACHED = 800_000
_SHORT = 64
_SHORTCUTS = 500_000
_ARROW_IDS = 4 << 20
_EDGES = re.compile(r"(?<=\w)(?=\W)|(?<=\W)(?=\w)")


class State:
    """The longest end of what was read that begins some piece, with all pieces that end there."""

    __slots__ = ("after", "depth", "ends", "shorter")

    def __init__(self, depth: int):
        self.after: dict[str, State] = {}
        self.depth = depth
        self.ends: tuple[tuple[int, float, int], ...] = ()  # (length, score, id), the longest first; id -1: bytes
        self.shorter: State | None = None  # of the next shorter end


class Vocabulary:
    """Pieces of a model file by text, with score and id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[float, int]] = {}
        self.texts: list[str | bytes] = []
        self.bytes: list[int] = [model.unk_id()] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.texts.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.texts.append("" if model.is_control(i) else " ⁇ ")
            else:
                self.pieces[piece] = (float(model.get_score(i)), i)
                self.texts.append(piece)
        self.longest = max(map(len, self.pieces))
        self.unknown = min(score for score, _ in self.pieces.values()) - 10
        self.root = self._automaton()
        self.shortcuts = 0
        self.splits_at_marks = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        used = set("".join(p for p in self.pieces if len(p) > 1))
        self.pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.lone = [c for c in map(chr, range(128)) if c not in used]  # no piece has them beside another character

    def _automaton(self) -> State:
        root, states = State(0), []
        for piece, (score, number) in self.pieces.items():
            state = root
            for c in piece:
                if c not in state.after:
                    state.after[c] = State(state.depth + 1)
                    states.append((state.after[c], state, c))
                state = state.after[c]
            state.ends = ((len(piece), score, number),)
        root.ends = ((1, self.unknown, -1),)
        states.sort(key=lambda found: found[0].depth)
        for state, before, c in states:
            shorter = before.shorter
            while shorter is not None and c not in shorter.after:
                shorter = shorter.shorter
            state.shorter = root if shorter is None else shorter.after[c]
            state.ends += state.shorter.ends if state.depth > 1 or not state.ends else ()
        return root

    def next(self, state: State, c: str) -> State:
        """The state after one more character, where no piece goes on with it; kept with the state, up to a number."""
        found = state.shorter
        while found is not None and c not in found.after:
            found = found.shorter
        if found is None:
            return self.root
        found = found.after[c]
        if self.shortcuts < _SHORTCUTS:
            self.shortcuts += 1
            state.after[c] = found
        return found


class StreamingViterbi:
    """Feed characters; ids come out as soon as they are certain."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.text = ""  # characters since the last commit
        self.best: list[float] = [0.0]
        self.back: list[tuple[int, float, int]] = [(0, 0.0, -1)]  # (length, score, id) of the piece that ends here; -1: bytes
        self.state = vocabulary.root
        self.commits = 0
        self.widest = 0

    def read(self, text: str) -> None:
        """Find the best sum and its last piece for the places behind further characters."""
        best, back, state, skip = self.best, self.back, self.state, self.vocabulary.next
        for end, c in enumerate(text, len(best)):
            state = state.after.get(c) or skip(state, c)
            top = -inf
            for piece in state.ends:
                total = best[end - piece[0]] + piece[1]
                if total > top:
                    top, last = total, piece
            best.append(top)
            back.append(last)
        self.state = state
        self.text += text

    def _converged(self) -> int:
        """The last boundary on all surviving paths: those to positions at which a piece yet to end can start."""
        n = len(self.text)
        alive = set(range(n - self.state.depth, n + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(last - self.back[last][0])
        return alive.pop()

    def _commit(self, boundary: int) -> list[int]:
        ids: list[int] = []
        at, back = boundary, self.back
        while at > 0:
            length, _, number = back[at]
            if number >= 0:
                ids.append(number)
            else:
                ids += [self.vocabulary.bytes[b] for b in reversed(self.text[at - length : at].encode("utf-8", "surrogatepass"))]
            at -= length
        self.widest = max(self.widest, len(self.text))
        self.commits += 1
        self.text, base = self.text[boundary:], self.best[boundary]
        self.best = [b - base for b in self.best[boundary:]]
        self.back = back[boundary:]
        ids.reverse()
        return ids

    def feed(self, text: str) -> Iterator[int]:
        for at in range(0, len(text), CHECK_EVERY):
            self.read(text[at : at + CHECK_EVERY])
            if len(self.text) > 2 * self.vocabulary.longest and (boundary := self._converged()):
                yield from self._commit(boundary)

    def finish(self) -> list[int]:
        ids = self._commit(len(self.text))
        self.state = self.vocabulary.root
        return ids


class _Known(dict):
    """Ids of parts, as bytes; a missing part is looked up."""

    def __init__(self, look_up: Callable[[str], bytes]):
        super().__init__()
        self.look_up = look_up

    def __missing__(self, part: str) -> bytes:
        self[part] = found = self.look_up(part)
        return found


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        lone = "".join(map(re.escape, v.lone))
        self.parts = re.compile(rf"[{lone}]+|{MARK}*[^{MARK}{lone}]+|{MARK}+") if v.splits_at_marks and lone else re.compile(r"(?s).+")
        self.raw = [piece if isinstance(piece, bytes) else piece.encode("utf-8", "surrogatepass") for piece in v.texts]
        self.forget()

    def forget(self) -> None:
        self.search = StreamingViterbi(self.vocabulary)  # empty again after every finish()
        self.known = _Known(lambda part: self._encode_part(part, self.search))
        self.long: list[str] = []

    def _pieces(self, part: str) -> list[str]:
        """The part cut at the edges of its words that no piece crosses."""
        pairs, out = self.vocabulary.pairs, []
        if part[1:].isalnum() and part[:2] in pairs:
            return [part]
        for stretch in _EDGES.split(part):
            if out and out[-1][-1] + stretch[0] in pairs:
                out[-1] += stretch
            else:
                out.append(stretch)
        return out

    def _encode_part(self, part: str, search: StreamingViterbi) -> bytes:
        if len(part) > _SHORT:
            self.long.append(part)
        elif len(pieces := self._pieces(part)) > 1:
            known = self.known
            for piece in pieces:
                if piece not in known:
                    known[piece] = self._encode_part(piece, search)
            return b"".join(map(known.__getitem__, pieces))
        ids = array("i", search.feed(part))
        ids.extend(search.finish())
        return ids.tobytes()

    def encode(self, text: str) -> array:
        ids, known = array("i"), self.known
        if text:
            ids.frombytes(b"".join(map(known.__getitem__, self.parts.findall(MARK + text.replace(" ", MARK)))))
            for part in self.long:  # each is kept within its text only
                known.pop(part, None)
            self.long.clear()
            if len(known) > _CACHED:
                for part in list(islice(known, len(known) // 2)):
                    del known[part]
        return ids

    def decode(self, ids) -> str:
        # a piece that is no byte starts with a whole character, so bytes before it end there
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


_OUT = pa.schema([("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("same_text", pa.bool_())])


def _free_names(taken: list[str]) -> list[str]:
    given, names = {name.lower() for name in taken}, []
    for name in _OUT.names:
        while name in given:
            name = f"_{name}"
        given.add(name)
        names.append(name)
    return names


def encode_documents(docs: DataFrame, model: str, carried: list[str], text: str = "text") -> DataFrame:
    """The carried columns with ``ids``, their number and crc32 (as little-endian 32-bit), and whether they decode to the text.

    A name that a carried column already has, in whatever case, gets underscores in front here: ``_ids`` beside a given ``ids``.
    """
    fields = [f for name in carried for f in docs.schema.fields if f.name == name]
    names = [f"c{i}" for i in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(model)
        try:
            for batch in batches:
                rows, start, size = [], 0, 0
                for at, value in enumerate(batch.column("data")):
                    source = value.as_py().decode("utf-8", "replace")
                    ids = use.encode(source)
                    rows.append((ids, len(ids), zlib.crc32(np.asarray(ids, dtype="<u4").tobytes()), use.decode(ids) == source.replace(MARK, " ")))
                    size += len(ids)
                    if size >= _ARROW_IDS or at == batch.num_rows - 1:
                        flat = pa.array(np.concatenate([np.asarray(r[0], dtype=np.int32) for r in rows]))
                        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [r[1] for r in rows]), pa.int32()), flat)
                        rest = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_OUT) if i]
                        kept = [batch.column(n).slice(start, at + 1 - start) for n in names]
                        yield pa.RecordBatch.from_arrays([*kept, lists, *rest], names=[*names, *_OUT.names])
                        rows, start, size = [], at + 1, 0
        finally:  # reused workers serve other stages next
            use.forget()

    source = docs.select(*[F.col(f"`{f.name}`").alias(n) for f, n in zip(fields, names, strict=True)], text_bytes(text).alias("data"))
    types = ", ".join(f"{n} {f.dataType.simpleString()}" for f, n in zip(fields, names, strict=True))
    out = source.mapInArrow(run, f"{types + ', ' if types else ''}ids array<int>, n_pieces bigint, ids_crc32 bigint, same_text boolean")
    return out.toDF(*carried, *_free_names(carried))
