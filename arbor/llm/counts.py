"""Token counts by a finite-state transducer compiled from a word-BPE tokenizer file.

The transducer reads characters of the normalised text. Its states are START (after white
space or a finished token), the prefixes of runs of letters and of runs of other signs, and
the beginnings of contractions; each transition carries the number of tokens that it emits:
a transition that ends a run emits the count of that run's merges. States are made as texts
first reach them (the transducer is deterministic, so they are the same wherever they are
made) and forgotten together when there are more than ``MAX_STATES``. A run of more than
``MAX_RUN`` characters is followed by its kind and start only, without states of its own, and
its merges are counted from a heap: memory in proportion to its length. White space leads back
to START from every state, so what lies between white space is a path from START to START:
paths that were taken before are kept as single transitions with their emitted counts.

A chunk's state map, from any state at its start to (tokens, state at its end), is held as
(head, count, tail): the text up to the first white space or digit, which depends on the state
before; the tokens from there on, which don't; and the text since the last one. ``compose``
joins two maps and is associative, so the maps of a long text's chunks are composed by a
prefix scan in parallel: neighbours first, then neighbours of those.

Defined results: a null text counts as empty (0 tokens); rows with the same id are counted
one by one; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import accumulate
from operator import attrgetter, getitem
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import cut, is_long
from .common import slabs, text_of

#: Code points of a chunk; states and whole paths that a worker holds; chunk maps composed in one task at a time.
CHUNK, MAX_STATES, MAX_PATHS, FAN_IN = 32768, 250_000, 1_000_000, 256
#: Characters of a run that has states, and of a stretch whose count is kept; characters between looks at the number of states.
MAX_RUN, PIECE = 64, 4096
#: Characters of a run after which no contraction is open any more.
_SETTLED = 8
_LONG = regex.compile(r"\p{L}{%d,}+|[^\s\p{L}\p{N}]{%d,}+" % (MAX_RUN + 1, MAX_RUN + 1))
#: Where a chunk's head and tail are cut off: white space, and digits, which are tokens by themselves. No normalisation or special string reaches across them.
_CUT = re.compile(r"[ \t\n0-9]")
# Fixed values of the pre-tokenizer: what an apostrophe at a token's start takes along.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

# Letters whose small forms the tokenizer's library takes otherwise than str.lower(), or which that doesn't know yet.
LOWER = {0x03A3: "\u03c3", 0xA7CB: "\u0264", 0xA7DC: "\u019b"}


def byte_signs() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class State(dict):
    """Transitions by character. ``emit``: tokens that the transition into this state emits."""

    __slots__ = ("base", "copies", "emit", "fst", "kind", "prefix")

    def __init__(self, fst: Transducer, kind: str, prefix: str, emit: int = 0, base: State | None = None):
        self.fst, self.kind, self.prefix, self.emit, self.base, self.copies = fst, kind, prefix, emit, base, None
        fst.states += 1

    def __missing__(self, char: str) -> State:
        state = self[char] = self.base[char] if self.base is not None else self.fst.step(self, char)
        return state

    def emitting(self, n: int) -> State:
        """This state, reached by a transition that emits n tokens more."""
        if not n:
            return self
        base, n = self.base if self.base is not None else self, n + self.emit
        if base.copies is None:
            base.copies = {}
        if n not in base.copies:
            base.copies[n] = State(self.fst, base.kind, base.prefix, n, base)
        return base.copies[n]


class Paths(dict):
    """Tokens emitted from START to START over a stretch without white space."""

    def __init__(self, fst: Transducer):
        self.fst = fst

    def __missing__(self, stretch: str) -> int:
        n = self.fst.run(stretch)
        if len(stretch) <= MAX_RUN:
            self[stretch] = n
        return n


_EMIT = attrgetter("emit")
#: What str.split() takes for white space and the tokenizer doesn't.
_NOT_SPACE = re.compile("[\x1c-\x1f]")


class Transducer:
    """The tokenizer at ``path`` as a deterministic transducer from characters to token counts."""

    _held: dict[str, Transducer] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.ranks = {tuple(m): i for i, m in enumerate(model["model"]["merges"])}
        self.suffix = model["model"]["end_of_word_suffix"] or ""
        special = [t["content"] for t in model["added_tokens"]]
        if any(map(_CUT.search, special)):
            raise ValueError("special strings with white space or digits aren't supported")
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.signs, self.kinds, self.joins = byte_signs(), {}, {}
        self.paths = Paths(self)
        self.reset()

    @classmethod
    def of(cls, path: str) -> Transducer:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def reset(self) -> None:
        self.states = 0
        self.start = State(self, "start", "")

    # -- compiling ---------------------------------------------------------------------

    def kind_of(self, char: str) -> str:
        kind = self.kinds.get(char)
        if kind is None:
            found = regex.match(r"(\s)|(\p{L})|(\p{N})", char)
            kind = self.kinds[char] = ("space", "letter", "number")[found.lastindex - 1] if found else "other"
        return kind

    def run_count(self, run: str) -> int:
        """Tokens of one pre-token: its merges, lowest rank first."""
        parts = [self.signs[b] for b in run.encode("utf-8")]
        parts[-1] += self.suffix
        if len(parts) > MAX_RUN:
            return self._merged_long(parts)
        get, none = self.ranks.get, 1 << 60
        pairs = [get(p, none) for p in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(pairs):
                pairs[i] = get((parts[i], parts[i + 1]), none)
        return len(parts)

    def _merged_long(self, parts: list[str | None]) -> int:
        """The same for long pre-tokens, with a heap of (rank, place) over a linked list: n log n."""
        n, get, joins = len(parts), self.ranks.get, self.joins
        after, before, left = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), n
        heap = [r << 40 | i for i in range(n - 1) if (r := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), 1 << 40)
            if parts[i] is None or (j := after[i]) >= n or get((parts[i], parts[j])) != rank:
                continue  # what stood here was merged with another neighbour
            if rank not in joins:
                joins[rank] = parts[i] + parts[j]
            parts[i], parts[j], left = joins[rank], None, left - 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := get((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(heap, r << 40 | k)
        return left

    def step(self, state: State, char: str) -> State:
        """The transition from ``state`` on ``char``, made when first needed."""
        kind, prefix = self.kind_of(char), state.prefix
        if state.kind == "start":
            if kind == "space":
                return self.start
            if kind == "number":
                return self.start.emitting(self.run_count(char))
            return State(self, "quote" if char == "'" else kind, char)
        if state.kind == "quote":
            grown = prefix + char
            if grown in CONTRACTIONS:
                return self.start.emitting(self.run_count(grown))
            if any(c.startswith(grown) for c in CONTRACTIONS):
                return State(self, "quote", grown)
            if len(prefix) == 1 and kind == "other":
                return State(self, "other", grown)
        elif state.kind == kind:
            return State(self, kind, prefix + char)
        after, n = self._ended(state)
        return self._then(after, char, n)

    def _ended(self, state: State) -> tuple[State, int]:
        """A run that goes no further: the state from which the next character is read, and the tokens emitted."""
        if state.kind == "quote" and len(state.prefix) > 1:  # no contraction after all: a sign, then letters
            after = self.start
            for c in state.prefix[1:]:
                after = after[c]
            return after, self.run_count("'")
        return self.start, self.run_count(state.prefix) if state.prefix else 0

    @staticmethod
    def _then(after: State, char: str, n: int) -> State:
        return after[char].emitting(n)

    # -- running -----------------------------------------------------------------------

    def _flush(self, state: State) -> int:
        state, n = state.base or state, 0
        while state is not self.start:
            state, k = self._ended(state)
            state, n = state.base or state, n + k
        return n

    def run(self, text: str) -> int:
        """Tokens emitted from START to the text's end, character by character."""
        if self.states > MAX_STATES:
            self.reset()
        if len(text) > MAX_RUN:
            return self._run_long(text)
        states = list(accumulate(text, getitem, initial=self.start))
        return sum(map(_EMIT, states)) + self._flush(states[-1])

    def _run_long(self, text: str) -> int:
        """The same for long texts: runs over MAX_RUN are skipped once their start is known."""
        state, at, n = self.start, 0, 0
        for m in _LONG.finditer(text):
            state, k = self._follow(state, text, at, m.start() + _SETTLED)
            n += k + self.run_count(text[m.start() + _SETTLED - len(state.prefix) : m.end()])
            state, at = self.start, m.end()
        state, k = self._follow(state, text, at, len(text))
        return n + k + self._flush(state)

    def _follow(self, state: State, text: str, start: int, end: int) -> tuple[State, int]:
        """The state at ``end`` and the tokens emitted on the way; states are forgotten on the way too."""
        n = 0
        for i in range(start, end, PIECE):
            if self.states > MAX_STATES:
                prefix = state.prefix
                self.reset()
                state = self.start
                for c in prefix:
                    state = state[c]
            states = list(accumulate(text[i : min(i + PIECE, end)], getitem, initial=state))
            n += sum(map(_EMIT, states)) - state.emit
            state = states[-1]
        return state, n

    def _run(self, text: str) -> int:
        if len(self.paths) > MAX_PATHS:
            self.paths.clear()
        if _NOT_SPACE.search(text):
            return self.run(text)
        return sum(map(self.paths.__getitem__, text.split()))

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).translate(LOWER)
        return text.lower()

    def count(self, text: str) -> int:
        """Tokens of a text that begins and ends at START; special strings are one token each."""
        if "<|" in text and self.special is not None:
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self._run(self.normal(p)) for p in parts)
        return self._run(self.normal(text))

    # -- chunks ------------------------------------------------------------------------

    def state_map(self, chunk: str) -> StateMap:
        cuts = [m.start() for m in _CUT.finditer(chunk)]
        if not cuts:
            return StateMap(chunk, -1, "")
        return StateMap(chunk[: cuts[0]], self.count(chunk[cuts[0] : cuts[-1] + 1]), chunk[cuts[-1] + 1 :])

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First ``a``, then ``b``."""
        if a.count < 0:
            return StateMap(a.head + b.head, b.count, b.tail)
        if b.count < 0:
            return StateMap(a.head, a.count, a.tail + b.head)
        return StateMap(a.head, a.count + self.count(a.tail + b.head) + b.count, b.tail)

    def scan(self, maps: list[StateMap]) -> StateMap:
        """All maps composed, neighbours first: as a parallel prefix scan goes up."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def total(self, whole: StateMap) -> int:
        """From START to the end of the text."""
        return self.count(whole.head) + (whole.count + self.count(whole.tail) if whole.count >= 0 else 0)


class StateMap(NamedTuple):
    """A chunk's effect on any state. count -1: no white space, so all of it is the head."""

    head: str
    count: int
    tail: str


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    fst = Transducer.of(path)
    for batch in slabs(batches, "_text"):
        texts = batch.column("_text").to_pylist()
        n_bytes = pc.binary_length(batch.column("_text")).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("_id"), n_bytes, pa.array([fst.count(t) for t in texts], pa.int64())], names=["_id", "n_bytes", "n_tokens"])


def _mapped(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    fst = Transducer.of(path)
    for batch in slabs(batches, "_text"):
        texts = batch.column("_text").to_pylist()
        head, count, tail = zip(*map(fst.state_map, texts)) if texts else ((), (), ())
        n_bytes = pc.binary_length(batch.column("_text")).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("_id", "_key", "_chunk")] + [n_bytes, pa.array(head, pa.string()), pa.array(count, pa.int64()), pa.array(tail, pa.string())],
            names=["_id", "_key", "_chunk", "n_bytes", "_head", "_count", "_tail"],
        )


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """(id, n_bytes, n_tokens) for each row. Texts over ``chunk`` code points are counted by chunks, dealt out over the tasks."""
    import pandas as pd

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    short = texts.where(~is_long(F.col("_text"), chunk)).mapInArrow(lambda b: _counted(b, path), f"_id {kind}, n_bytes long, n_tokens long")
    long = texts.where(is_long(F.col("_text"), chunk)).withColumn("_key", F.monotonically_increasing_id())
    chunks = cut(long, "_text", chunk).select("_id", "_key", "_chunk", "_text").repartition("_key", "_chunk")
    maps = chunks.mapInArrow(lambda b: _mapped(b, path), f"_id {kind}, _key long, _chunk int, n_bytes long, _head string, _count long, _tail string")

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        whole = Transducer.of(path).scan([StateMap(*x) for x in zip(pdf["_head"], pdf["_count"], pdf["_tail"])])
        return pdf.iloc[:1].assign(n_bytes=pdf["n_bytes"].sum(), _head=whole.head, _count=whole.count, _tail=whole.tail)

    def ended(pdf: pd.DataFrame) -> pd.DataFrame:
        one = composed(pdf)
        n = Transducer.of(path).total(StateMap(one["_head"].iloc[0], one["_count"].iloc[0], one["_tail"].iloc[0]))
        return one[["_id", "n_bytes"]].assign(n_tokens=n)

    near = maps.groupBy("_key", F.expr(f"_chunk div {fan_in}")).applyInPandas(composed, maps.schema)
    whole = near.groupBy("_key").applyInPandas(ended, f"_id {kind}, n_bytes long, n_tokens long")
    return short.unionByName(whole).withColumnRenamed("_id", id_col)
