"""Token counts by a finite-state transducer.

The transducer reads a word byte by byte. A state holds the vocabulary-trie nodes of all
suffixes that may still grow into a token, each with the last token before that suffix and
the number of tokens up to there, relative to the present. A transition's output is the
change of the word's token count, so the outputs along a word add up to its number of tokens.
States are found by subset construction when text first reaches them and kept in a table of
bounded size, as lazy automata do.

A text is cut into chunks of equal byte length. What a chunk does to an incoming state is a
small *state map*: a head (the bytes up to the first word start, which depend on the incoming
state), and behind it a fixed count and exit state, because the transducer starts anew at
every word start. The maps compose associatively: a parallel prefix scan gives the count at
every chunk's end, and its up-sweep alone, a tree of compositions of neighbours, the count of the
whole text. A head is kept as its chunks, not joined, and read once in the tree, so a text
without a word start takes time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .bpe import ROOT, Vocabulary, split_words, vocabulary
from .common import slices, text_or_empty

#: Characters worked on at once in a task, and bounds of the tables kept by a Python worker.
SLICE_CHARS, MAX_STATES, MAX_WORDS = 2_000_000, 100_000, 300_000
#: Bytes of a word up to which it is counted for itself, whatever chunks it lies in, and kept.
LONG_WORD = 64


class State:
    __slots__ = ("items", "next")

    def __init__(self, items: tuple[tuple[int, int, int], ...]):
        self.items = items  # (trie node, token before it, tokens up to there minus tokens now)
        self.next: dict[int, tuple[State, int]] = {}


class Transducer:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.start = State(((ROOT, -1, 0),))
        self.states: dict[tuple, State] = {}

    def step(self, state: State, byte: int) -> tuple[State, int]:
        """The next state and the emitted count; found once for each state and byte."""
        found = state.next.get(byte)
        if found is None:
            found = state.next[byte] = self._compile(state, byte)
        return found

    def _compile(self, state: State, byte: int) -> tuple[State, int]:
        v = self.vocab
        edges, token_at, inner, beside = v.edges.get, v.token_at, v.inner, v.beside.get
        grown, last, count = [], -1, 0
        for node, before, tokens in state.items:
            child = edges(node << 8 | byte)
            if child is None:
                continue
            if last < 0 and (token := token_at[child]) >= 0:
                fits = True if before < 0 else beside(before << 20 | token)
                if v.side_by_side(before, token) if fits is None else fits:
                    last, count = token, tokens + 1
            if inner[child]:
                grown.append((child, before, tokens))
        if last < 0:
            raise ValueError("the vocabulary lacks a token for a byte")
        items = (*((n, b, t - count) for n, b, t in grown), (ROOT, last, 0))
        state = self.states.get(items)
        if state is None:
            if len(self.states) >= MAX_STATES:  # states in use keep their items and go on
                self.states.clear()
                self.start.next.clear()
            state = self.states[items] = State(items)
        return state, count

    def count(self, word: bytes) -> int:
        """Tokens of a whole word. Of its last byte only the output is worked out: most new words
        share all but that with words before them, and the state behind it is rarely gone on from."""
        state, total = self.run(self.start, word[:-1])
        byte = word[-1]
        found = state.next.get(byte)
        if found is not None:
            return total + found[1]
        edges, token_at, beside = self.vocab.edges.get, self.vocab.token_at, self.vocab.beside.get
        for node, before, tokens in state.items:
            child = edges(node << 8 | byte)
            if child is None:
                continue
            token = token_at[child]
            if token >= 0:
                fits = True if before < 0 else beside(before << 20 | token)
                if self.vocab.side_by_side(before, token) if fits is None else fits:
                    return total + tokens + 1
        raise ValueError("the vocabulary lacks a token for a byte")

    def run(self, state: State, data: bytes) -> tuple[State, int]:
        total = 0
        for byte in data:
            found = state.next.get(byte)
            state, emitted = found if found is not None else self.step(state, byte)
            total += emitted
        return state, total


@dataclass(frozen=True)
class StateMap:
    """What a stretch of text does to the state: ``head`` (its parts in order) is read from the
    incoming state; if the stretch has a word start, ``count`` more tokens follow and ``exit`` is
    the state at its end, whatever came in."""

    head: tuple[bytes, ...]
    count: int = 0
    exit: State | None = None

    def __post_init__(self):
        if isinstance(self.head, bytes):
            object.__setattr__(self, "head", (self.head,) if self.head else ())

    def apply(self, transducer: Transducer, state: State) -> tuple[State, int]:
        total = 0
        for part in self.head:
            state, emitted = transducer.run(state, part)
            total += emitted
        return (state if self.exit is None else self.exit), total + self.count

    def then(self, after: StateMap, transducer: Transducer) -> StateMap:
        if self.exit is None:
            return StateMap(self.head + after.head, after.count, after.exit)
        state, total = after.apply(transducer, self.exit)
        return StateMap(self.head, self.count + total, state)


def prefix_scan(maps: list[StateMap], transducer: Transducer) -> list[StateMap]:
    """``maps[0] then ... then maps[i]`` for each i, in log2(n) rounds whose compositions
    do not depend on each other."""
    step = 1
    while step < len(maps):
        maps = [m if i < step else maps[i - step].then(m, transducer) for i, m in enumerate(maps)]
        step *= 2
    return maps


def composed(maps: list[StateMap], transducer: Transducer) -> StateMap:
    """``maps[0] then ... then maps[-1]``: the scan's up-sweep, neighbours first."""
    while len(maps) > 1:
        pairs = [a.then(b, transducer) for a, b in zip(maps[::2], maps[1::2])]
        maps = pairs + maps[len(maps) & ~1 :]
    return maps[0]


@lru_cache(maxsize=2)
def _worker(path: str) -> tuple[Transducer, dict[bytes, int]]:
    return Transducer(vocabulary(path)), {}


def _count_plain(texts: list[str], path: str, chunk_bytes: int) -> list[tuple[int, int]]:
    """(UTF-8 bytes, tokens) of each text; texts hold no special tokens."""
    transducer, known = _worker(path)
    start = transducer.start
    data, offsets, first = split_words(texts)
    at = offsets.tolist()
    counts = _word_counts([data[a:b] for a, b in zip(at[:-1], at[1:])], transducer, known)
    before = np.concatenate([[0], np.cumsum(np.maximum(counts, 0))])  # tokens of the short words before each
    long = np.flatnonzero(counts < 0)
    out = []
    for i in range(len(texts)):
        lo, hi = int(first[i]), int(first[i + 1])
        begin, end = at[lo], at[hi]
        maps = []
        for cut in range(begin, end, chunk_bytes):
            stop = min(cut + chunk_bytes, end)
            # words that start in this chunk; the last one may go on behind it
            a, b = (np.searchsorted(offsets[lo:hi], [cut, stop]) + lo).tolist() if end - begin > chunk_bytes else (lo, hi)
            head = data[cut : at[a] if a < b else stop]
            if a == b:
                maps.append(StateMap(head))
                continue
            cross = at[b] > stop
            whole = int(before[b - cross] - before[a])
            if len(long):
                whole += sum(transducer.count(data[at[k] : at[k + 1]]) for k in long[slice(*np.searchsorted(long, [a, b - cross]))].tolist())
            state, tail = transducer.run(start, data[at[b - 1] : stop]) if cross else (start, 0)
            maps.append(StateMap(head, whole + tail, state))
        tokens = composed(maps, transducer).apply(transducer, start)[1] if maps else 0
        out.append((end - begin, tokens))
    return out


def _word_counts(words: list[bytes], transducer: Transducer, known: dict[bytes, int]) -> np.ndarray:
    """Tokens of each word, -1 for one of more than ``LONG_WORD`` bytes. New words are sorted, so
    that states just found are used again, and kept in ``known`` up to its bound."""
    new = set(words).difference(known)
    if len(known) + len(new) > MAX_WORDS:
        known.clear()
        new = set(words)
    table = known if len(new) <= MAX_WORDS else {}  # a slice of very many words
    long = {w for w in new if len(w) > LONG_WORD}
    for word in sorted(new - long):
        table[word] = transducer.count(word)
    return np.fromiter((table.get(w, -1) for w in words) if long else map(table.__getitem__, words), np.int64, len(words))


def count_texts(texts: list[str], path: str, chunk_bytes: int) -> list[tuple[int, int]]:
    """(UTF-8 bytes, tokens) of each text. A special token's string counts one token and
    ends the text before it, as the library does by default."""
    special = [s.decode() for s in vocabulary(path).special]
    pieces, extra = [], []
    for t in texts:
        parts = [t]
        for s in special:
            parts = [p for x in parts for p in x.split(s)] if s in t else parts
        pieces += parts
        extra.append((len(parts), len(t.encode()) if len(parts) > 1 else -1))
    counts = iter(_count_plain(pieces, path, chunk_bytes))
    out = []
    for n, size in extra:
        got = [next(counts) for _ in range(n)]
        out.append((sum(b for b, _ in got) if size < 0 else size, sum(c for _, c in got) + n - 1))
    return out


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = 16_384,
    over: int = 1024,
) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``over``).

    ``tokenizer`` is the path of a byte-level BPE file on every worker. Null text counts as
    empty: 0 bytes, 0 tokens. Ids are passed through as they are, null or repeated; other
    columns are not read. An empty table gives no rows.

    Scale: no shuffle and nothing collected; a task's memory holds one Arrow batch, one slice
    of ``SLICE_CHARS`` characters (or one text) and two tables of bounded size.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            lengths = np.asarray(pc.binary_length(texts))
            found: list[tuple[int, int]] = []
            for a, b in slices(lengths.tolist(), SLICE_CHARS):
                found += count_texts(texts.slice(a, b - a).to_pylist(), tokenizer, chunk_bytes)
            n_bytes = np.array([f[0] for f in found], dtype=np.int64)
            tokens = np.array([f[1] for f in found], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes), pa.array(tokens), pa.array(tokens > over)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("_text"))
    return rows.mapInArrow(work, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
