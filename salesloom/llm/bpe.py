"""Byte-level BPE from a tokenizer file: the vocabulary as a byte trie, the test whether two
tokens can stand side by side in an encoding, and a vectorised pre-tokenizer.

An encoding is what BPE makes of a word by merging the lowest-ranked pair, leftmost first,
until no pair can be merged. Two facts carry both operators built on this module:

* A token sequence is the encoding of its bytes exactly when each token is the encoding of
  its own bytes and each two neighbours, taken alone, do not merge across their border
  (``Vocabulary.side_by_side``). Until the first merge across a border the two sides evolve
  as they would alone, and merges happen in order of rank.
* So every prefix of a word has exactly one *last token*: the one token that ends the prefix
  and can follow the last token of what precedes it. Encodings can be built left to right.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from tokenizers.pre_tokenizers import ByteLevel

ROOT = 0
#: Rank of a merge that never happens.
NEVER = 1 << 60

#: Fixed value: the pattern that cuts a text into words before merging.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable Latin-1 bytes
    stand for themselves, the others for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, their byte trie (``edges[node << 8 | byte]``, ``token_at[node]``) and merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("a byte-level BPE without normalizer or dropout is needed")
        letters = byte_letters()
        ids = model["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in ids.items() if all(c in letters for c in t)}
        self.special = {a["content"].encode(): a["id"] for a in spec.get("added_tokens", [])}
        self.merge: dict[int, int] = {}  # left << 20 | right -> rank
        made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, t = ids[left], ids[right], ids[left + right]
            self.merge[a << 20 | b] = rank
            made.setdefault(t, (rank, a, b))
        # What stands at a token's right (left) border over time: (token, rank that ends it).
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        good = []
        for t, raw in self.bytes_of.items():
            if len(raw) == 1:
                self._right[t] = self._left[t] = [(t, NEVER)]
                good.append(t)
        for t, (rank, a, b) in made.items():  # in order of rank: parts come first
            self._right[t] = [*self._right[b][:-1], (b, rank), (t, NEVER)]
            self._left[t] = [*self._left[a][:-1], (a, rank), (t, NEVER)]
            if self._first_across(a, b) == rank:
                good.append(t)
        self.edges: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.inner: list[bool] = [True]  # has edges
        for t in good:
            node = ROOT
            for c in self.bytes_of[t]:
                child = self.edges.get(node << 8 | c)
                if child is None:
                    child = self.edges[node << 8 | c] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = child
            self.token_at[node] = t
        self.beside: dict[int, bool] = {}

    def _first_across(self, a: int, b: int) -> int:
        """Rank of the first merge across the border of neighbours a and b; NEVER if none."""
        right, left, merge = self._right[a], self._left[b], self.merge
        i = j = 0
        while True:
            (x, x_end), (y, y_end) = right[i], left[j]
            rank = merge.get(x << 20 | y, NEVER)
            # equal ranks: the leftmost pair is merged first
            if rank < x_end and rank <= y_end and rank != NEVER:
                return rank
            if x_end == y_end == NEVER:
                return NEVER
            i, j = i + (x_end <= y_end), j + (y_end <= x_end)

    def side_by_side(self, a: int, b: int) -> bool:
        key = a << 20 | b
        found = self.beside.get(key)
        if found is None:
            if len(self.beside) > 1_000_000:
                self.beside.clear()
            found = self.beside[key] = self._first_across(a, b) == NEVER
        return found


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary, built once in each Python worker."""
    return Vocabulary(path)


OTHER, LETTER, NUMBER, SPACE, WHITE, EDGE = range(6)


#: The code points with the Unicode property White_Space, beside the space.
WHITE_POINTS = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point. Letters and numbers that only the newer of two
    Unicode tables has are put to the tokenizers library, which has a table of its own."""
    table = np.zeros(0x110001, dtype=np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    splitter = ByteLevel(add_prefix_space=False, use_regex=True)
    for kind, pattern, sample in ((LETTER, r"\p{L}+", "a"), (NUMBER, r"\p{N}+", "0")):
        for m in regex.finditer(pattern, everything):
            at = ord(m[0][0])
            table[at : at + len(m[0])] = kind
            for c in m[0] if at > 0x2FF else "":
                if unicodedata.category(c) == "Cn" and len(splitter.pre_tokenize_str(sample + c)) > 1:
                    table[ord(c)] = OTHER
    table[WHITE_POINTS] = WHITE
    table[0x20] = SPACE
    table[0x110000] = EDGE
    return table


def split_words(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """UTF-8 of all texts end to end, the byte offsets where words start (and the end), and
    for each text the index of its first word (and the end).

    The pattern above needs only a letter's class, its neighbours' and three letters of
    look-ahead, so the borders of all texts are found at once, without scanning.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    raw = "".join(texts)
    points = np.frombuffer(raw.encode("utf-32-le"), dtype=np.uint32)
    # one edge mark before, between and after the texts
    begins = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.insert(points, begins, 0x110000)
    kind = _classes()[marked]
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[1:], before[0] = kind[:-1], EDGE
    after[:-1], after[-1] = kind[1:], EDGE
    solid = kind <= NUMBER
    white = (kind == SPACE) | (kind == WHITE)
    start = solid & (before != kind) & (before != SPACE)
    start |= white & ((before != SPACE) & (before != WHITE) | (after <= NUMBER))
    # contractions: an apostrophe that starts a word, and its letters
    marks = np.flatnonzero((marked == 0x27) & (before != OTHER) & (before != SPACE))
    if len(marks):
        padded = np.concatenate([marked, [0x110000] * 3]).astype(np.uint32)
        one, two = padded[marks + 1], padded[marks + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for found, n in ((short, 2), (long, 3)):
            at = marks[found]
            for k in range(1, n):
                start[at + k] = False
            end = at + n
            start[end[kind[end] == LETTER]] = True
    own = kind != EDGE
    start, points = start[own], marked[own]
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    offset = np.concatenate([[0], np.cumsum(width)])
    where = np.flatnonzero(start)
    return raw.encode(), np.append(offset[where], offset[-1]), np.searchsorted(where, begins)
