"""Secret scan with one combined deterministic automaton.

The rules' regular expressions are parsed into one nondeterministic automaton over bytes; subset
construction and minimisation turn it into transition arrays over byte classes. Two are built:

* the *reverse* automaton of all rules after any text, run once backwards over the bytes: its state
  at a byte tells which rules have a match that starts there;
* a *forward* automaton for each rule, run from such a start to the longest end.

Taking, for each rule, the leftmost start at or after the last match's end gives the leftmost
non-overlapping matches. The one pass over all bytes reads a batch of documents as one buffer in a
few thousand lanes that step together. A lane first assumes the initial state at its right edge;
lanes whose neighbour left another state are run again until they meet the states they had, so
the result is that of one serial pass over texts of any length.

Matches are longest matches (the rules given here have only one for a start). Offsets are code
points, ends are exclusive. Null texts are empty; a text without matches has zero counts, the hash
of the empty string and an empty ``spans``. Repeated rows and null ids each give their row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import text_bytes

_SEPARATOR = 0xFF  # never a byte of UTF-8
_LANES = 4096
_SLICE = 4 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression and the least length of a match, or of the value at its end."""

    kind: str
    pattern: str
    least: int = 0
    value: str = ""  # the expression of the match's tail whose length counts, if not the whole match's
    base: bool = True


# The kinds, expressions and least lengths that results are defined by.
BASE_RULES = (
    Rule("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=\-]+", 8, r"[A-Za-z0-9+/_.=\-]+"),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
MORE_RULES = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}", base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", base=False),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
)


class _Nfa:
    """A byte automaton with empty moves, built bottom-up from an expression."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def build(self, node, start: int, end: int, backwards: bool) -> None:
        kind = node[0]
        if kind == "bytes":
            self.moves[start].append((node[1], end))
        elif kind == "seq":
            parts = node[1][::-1] if backwards else node[1]
            at = start
            for part in parts:
                after = self.state()
                self.build(part, at, after, backwards)
                at = after
            self.empty[at].append(end)
        elif kind == "or":
            for part in node[1]:
                self.build(part, start, end, backwards)
        else:
            _, part, least, most = node
            at = start
            for _ in range(least):
                after = self.state()
                self.build(part, at, after, backwards)
                at = after
            if most is None:
                loop = self.state()
                self.empty[at].append(loop)
                self.build(part, loop, loop, backwards)
                self.empty[loop].append(end)
                return
            for _ in range(most - least):
                self.empty[at].append(end)
                after = self.state()
                self.build(part, at, after, backwards)
                at = after
            self.empty[at].append(end)

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        found, stack = set(), list(states)
        while stack:
            state = stack.pop()
            if state not in found:
                found.add(state)
                stack += self.empty[state]
        return frozenset(found)


def parse(pattern: str):
    """Expression tree of literals, classes, groups, ``|`` and the repeats ``* + ? {m} {m,} {m,n}``."""
    at = 0

    def alternatives():
        nonlocal at
        options = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence():
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            part = atom()
            while at < len(pattern) and pattern[at] in "*+?{":
                least, most = repeat()
                part = ("repeat", part, least, most)
            parts.append(part)
        return ("seq", parts)

    def repeat():
        nonlocal at
        mark = pattern[at]
        at += 1
        if mark != "{":
            return {"*": (0, None), "+": (1, None), "?": (0, 1)}[mark]
        end = pattern.index("}", at)
        least, comma, most = pattern[at:end].partition(",")
        at = end + 1
        return int(least), (int(most) if most else None) if comma else int(least)

    def one_byte() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "\\":
            c = pattern[at]
            at += 1
            if c == "x":
                at += 2
                return int(pattern[at - 2 : at], 16)
        if ord(c) > 127:
            raise ValueError("expressions are over ASCII")
        return ord(c)

    def atom():
        nonlocal at
        if pattern[at] == "(":
            at += 1
            inner = alternatives()
            at += 1
            return inner
        if pattern[at] == ".":
            at += 1
            return ("bytes", frozenset(range(128)) - {10})
        if pattern[at] != "[":
            return ("bytes", frozenset([one_byte()]))
        at += 1
        negated = pattern[at] == "^"
        at += negated
        members = set()
        while pattern[at] != "]":
            low = one_byte()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                members |= set(range(low, one_byte() + 1))
            else:
                members.add(low)
        at += 1
        return ("bytes", frozenset(set(range(128)) - members if negated else members))

    tree = alternatives()
    if at != len(pattern):
        raise ValueError(f"unbalanced expression: {pattern}")
    return tree


@dataclass(frozen=True)
class Automaton:
    """``moves[state * classes + class_of[byte]]`` is the next state; ``accepts`` has a bit for each rule; 0 is the start."""

    class_of: np.ndarray
    classes: int
    moves: np.ndarray
    accepts: np.ndarray


def compile_rules(rules: Iterable[Rule], backwards: bool, anywhere: bool) -> Automaton:
    """Subset construction and minimisation; ``anywhere`` lets matches begin at every byte."""
    nfa, ends, starts = _Nfa(), {}, []
    for bit, rule in enumerate(rules):
        start, end = nfa.state(), nfa.state()
        nfa.build(parse(rule.pattern), start, end, backwards)
        starts.append(start)
        ends[end] = 1 << bit
    # bytes that no expression tells apart form a class; the separator is a class of its own
    sets = list({members for moves in nfa.moves for members, _ in moves})
    signature = {b: tuple(b in s for s in sets) + (b == _SEPARATOR,) for b in range(256)}
    kinds = {s: i for i, s in enumerate(dict.fromkeys(signature.values()))}
    class_of = np.array([kinds[signature[b]] for b in range(256)], np.uint8)
    sample = [int(np.flatnonzero(class_of == c)[0]) for c in range(len(kinds))]
    begin = nfa.closure(starts)
    number, order, table = {begin: 0}, [begin], []
    for current in order:
        row = []
        for byte in sample:
            if byte == _SEPARATOR:
                target = begin
            else:
                target = nfa.closure([to for state in current for members, to in nfa.moves[state] if byte in members] + (starts if anywhere else []))
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        table.append(row)
    accepts = np.array([sum(ends.get(s, 0) for s in states) for states in order], np.int64)
    moves, accepts = _minimised(np.array(table), accepts)
    return Automaton(class_of, len(kinds), moves.astype(np.int32).ravel(), accepts)


def _minimised(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Refine the partition by accepted rules until states of a block agree on the blocks they lead to."""
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    # blocks are numbered by their first state, so that the start stays 0
    _, first = np.unique(block, return_index=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    chosen = np.sort(first)
    return rank[block[table[chosen]]], accepts[chosen]


def starts_of(buffer: np.ndarray, machine: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a byte buffer at which some rule's match starts, and the rules' bits there."""
    n = len(buffer)
    lanes = max(1, min(_LANES, n // 64))
    width = -(-n // lanes)
    padded = np.full(lanes * width, _SEPARATOR, np.uint8)
    padded[:n] = buffer
    columns = np.ascontiguousarray(machine.class_of[padded].reshape(lanes, width).T)
    moves = machine.moves * machine.classes  # states are kept multiplied
    trail = np.empty((width, lanes), np.int32)
    state = np.zeros(lanes, np.int32)
    for at in range(width - 1, -1, -1):
        state = moves[state + columns[at]]
        trail[at] = state
    entry = np.zeros(lanes, np.int32)
    while True:
        true = np.r_[trail[0, 1:], np.int32(0)]
        wrong = np.flatnonzero(true != entry)
        if not len(wrong):
            break
        entry[wrong] = true[wrong]
        state = true[wrong]
        for at in range(width - 1, -1, -1):
            state = moves[state + columns[at, wrong]]
            open_ = state != trail[at, wrong]
            wrong, state = wrong[open_], state[open_]
            if not len(wrong):
                break
            trail[at, wrong] = state
    accepts = np.zeros(len(moves), np.uint8)
    accepts[:: machine.classes] = machine.accepts
    bits = accepts[trail]
    hit_at, hit_lane = np.nonzero(bits)
    positions = hit_lane * width + hit_at
    order = np.argsort(positions)
    return positions[order], bits[hit_at[order], hit_lane[order]]


def _longest(data: bytes, start: int, machine: tuple) -> int:
    """End of the longest match of a rule's forward automaton from ``start``; -1 if there is none."""
    class_of, classes, moves, accepts, dead = machine
    state, end = 0, -1
    for at in range(start, len(data)):
        state = moves[state * classes + class_of[data[at]]]
        if state == dead:
            break
        if accepts[state]:
            end = at + 1
    return end


class Scanner:
    """All rules over documents of UTF-8 bytes."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.reverse = compile_rules(rules, backwards=True, anywhere=True)
        self.forward = [self._plain(compile_rules([rule], backwards=False, anywhere=False)) for rule in rules]
        self.tails = {i: self._plain(compile_rules([Rule(r.kind, r.value)], backwards=True, anywhere=False)) for i, r in enumerate(rules) if r.value}

    @staticmethod
    def _plain(machine: Automaton) -> tuple:
        moves = machine.moves.tolist()
        rows = [moves[i : i + machine.classes] for i in range(0, len(moves), machine.classes)]
        separator = int(machine.class_of[_SEPARATOR])
        dead = next((s for s, row in enumerate(rows) if not machine.accepts[s] and all(to == s for c, to in enumerate(row) if c != separator)), -1)
        return machine.class_of.tolist(), machine.classes, moves, machine.accepts.tolist(), dead

    def scan(self, documents: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each document its matches (start byte, end byte, rule number), by start, then rule."""
        sizes = np.array([len(d) + 1 for d in documents])
        offsets = np.cumsum(sizes) - sizes
        buffer = np.frombuffer(b"".join(d + b"\xff" for d in documents), np.uint8)
        positions, bits = starts_of(buffer, self.reverse)
        owner = np.searchsorted(offsets, positions, side="right") - 1
        out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
        for number, machine in enumerate(self.forward):
            mine = np.flatnonzero(bits >> number & 1)
            document, done = -1, 0
            for at, own in zip(positions[mine].tolist(), owner[mine].tolist(), strict=True):
                if own != document:
                    document, done = own, 0
                start = at - int(offsets[own])
                if start < done:
                    continue
                done = _longest(documents[own], start, machine)
                if self._counts(number, documents[own][start:done]):
                    out[own].append((start, done, number))
        for found in out:
            found.sort(key=lambda m: (m[0], m[2]))
        return out

    def _counts(self, number: int, match: bytes) -> bool:
        """Whether a match, or its tail, is long enough."""
        rule = self.rules[number]
        if number not in self.tails:
            return len(match) >= rule.least
        return self._tail(match, number) >= rule.least

    def _tail(self, match: bytes, number: int) -> int:
        """Length of the value: what the match's tail expression takes after the last separator that the rule needs."""
        whole = self.forward[number]
        value = _longest(match[::-1], 0, self.tails[number])
        # the tail class may also hold a separator (as in ``key==x``): the value starts at the first
        # byte from which on every prefix of the match is a match of the rule
        class_of, classes, moves, accepts, _ = whole
        state, first = 0, len(match)
        for at, byte in enumerate(match):
            state = moves[state * classes + class_of[byte]]
            if accepts[state]:
                first = min(first, at)
        return min(value, len(match) - first)


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets as code-point offsets."""
    if not spans or data.isascii():
        return spans
    continued = np.cumsum(np.r_[0, (np.frombuffer(data, np.uint8) & 0xC0) == 0x80])
    return [(int(a - continued[a]), int(b - continued[b]), k) for a, b, k in spans]


_RESULT = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def _joined(rules, spans) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Each row's id, counts of the base kinds, hash of the base spans and all spans."""
    base_kinds, scan = ("assign", "access", "hex"), scanner(rules)  # compiled here, sent to the tasks as arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ids in _slices(batch):
                rows = []
                for found, document in zip(scan.scan(data), data, strict=True):
                    found = code_points(document, found)
                    base = [m for m in found if rules[m[2]].base]
                    kinds = [rules[m[2]].kind for m in base]
                    rows.append((*(kinds.count(k) for k in base_kinds), hashlib.sha256(_joined(rules, base).encode()).hexdigest(), _joined(rules, found)))
                arrays = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_RESULT)]
                yield pa.RecordBatch.from_arrays([ids, *arrays], names=["row_id", *_RESULT.names])

    id_type = docs.schema[id_column].dataType.simpleString()
    found = docs.select(F.col(id_column).alias("row_id"), text_bytes(text).alias("data"))
    return found.mapInArrow(run, f"row_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string").withColumnRenamed("row_id", id_column)


def _slices(batch: pa.RecordBatch, most: int = _SLICE) -> Iterator[tuple[list[bytes], pa.Array]]:
    """A batch in runs of about ``most`` bytes, so that the lanes' memory is bounded by it or by one document."""
    data, ids, start, size = [], batch.column("row_id"), 0, 0
    for at, value in enumerate(batch.column("data")):
        data.append(value.as_py())
        size += len(data[-1])
        if size >= most:
            yield data, ids.slice(start, at + 1 - start)
            data, start, size = [], at + 1, 0
    if data:
        yield data, ids.slice(start)


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, mark: str = "[{kind}]") -> DataFrame:
    """The rows with each matched span replaced by its kind in brackets; null texts stay null, columns as given.

    Where spans of several rules overlap, they go as one, under the first one's kind.
    """

    scan = scanner(rules)

    def clean(texts: pd.Series) -> pd.Series:
        out, held, size = [], [], 0
        for at, value in enumerate(texts):
            held.append(value)
            size += len(value or "")
            if size >= _SLICE or at == len(texts) - 1:
                data = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in held]
                out += [t if not spans else _without(d, spans).decode() for t, d, spans in zip(held, data, scan.scan(data), strict=True)]
                held, size = [], 0
        return pd.Series(out, dtype=object)

    def _without(document: bytes, spans) -> bytes:
        parts, done = [], 0
        for start, end, kind in spans:
            if start >= done:
                parts += [document[done:start], mark.format(kind=rules[kind].kind).encode()]
            done = max(done, end)
        return b"".join([*parts, document[done:]])

    return docs.withColumn(text, F.pandas_udf(clean, T.StringType())(F.col(text).cast("string")))
