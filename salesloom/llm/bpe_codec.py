"""BPE encoding and decoding over a prefix-sharing trie of distinct words.

The distinct words of a slice of texts that are not yet known are sorted, which is a
depth-first walk of their trie: between two words the walk goes back to their common prefix
and on from there. Each trie node on the path holds the last-token state of its prefix: the
suffixes that may still become a token, the prefix's last token and where that starts, which
leads to the state of the encoding before it. So what words share at their front is worked out
once, and a word's ids are read off by going from last token to last token.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .bpe import ROOT, Vocabulary, split_words, vocabulary
from .common import give_back, slices, text_batches, text_or_empty

#: Characters worked on at once in a task, and the words a Python worker keeps.
SLICE_CHARS, MAX_WORDS = 500_000, 150_000


def release(path: str) -> None:
    """Drop what a task has learnt of words and pairs: workers are reused by other stages. The
    vocabulary stays."""
    vocab, known, _ = _worker(path)
    known.clear()
    vocab.beside.clear()
    give_back()


def encode_words(words: list[bytes], vocab: Vocabulary) -> Iterator[tuple[bytes, bytes]]:
    """(word, its ids as little-endian 32-bit integers), for distinct words in sorted order."""
    edges, token_at, inner, beside = vocab.edges, vocab.token_at, vocab.inner, vocab.beside
    ask = vocab.side_by_side
    packed = _packed(vocab)
    # by depth: suffixes that may grow (node, token before, depth where it starts), last token
    # of the prefix, and the depth where that token starts
    states: list[list[tuple[int, int, int]]] = [[(ROOT, -1, 0)]]
    lasts, starts = [-1], [0]
    previous = b""
    for word in words:
        shared = 0
        for x, y in zip(previous, word):
            if x != y:
                break
            shared += 1
        del states[shared + 1 :], lasts[shared + 1 :], starts[shared + 1 :]
        depth = shared
        for byte in word[shared:]:
            grown, last, start = [], -1, 0
            for node, before, began in states[depth]:
                child = edges.get(node << 8 | byte)
                if child is None:
                    continue
                token = token_at[child]
                if token >= 0 and last < 0:
                    fits = True if before < 0 else beside.get(before << 20 | token)
                    if ask(before, token) if fits is None else fits:
                        last, start = token, began
                if inner[child]:
                    grown.append((child, before, began))
            if last < 0:
                raise ValueError("the vocabulary lacks a token for a byte")
            depth += 1
            grown.append((ROOT, last, depth))
            states.append(grown)
            lasts.append(last)
            starts.append(start)
        ids = []
        while depth:
            ids.append(packed[lasts[depth]])
            depth = starts[depth]
        yield word, b"".join(reversed(ids))
        previous = word


@lru_cache(maxsize=2)
def _packed(vocab: Vocabulary) -> dict[int, bytes]:
    return {t: t.to_bytes(4, "little") for t in vocab.bytes_of}


@lru_cache(maxsize=2)
def _worker(path: str) -> tuple[Vocabulary, dict[bytes, bytes], list[bytes]]:
    vocab = vocabulary(path)
    table = [b""] * (1 + max([*vocab.bytes_of, *vocab.special.values()]))
    for t, raw in [*vocab.bytes_of.items(), *((i, s) for s, i in vocab.special.items())]:
        table[t] = raw
    return vocab, {}, table


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit integers end to end."""
    vocab, known, _ = _worker(path)
    special = [(s.decode(), i.to_bytes(4, "little")) for s, i in vocab.special.items()]
    pieces: list[str] = []
    plan: list[list[bytes | None]] = []  # for each text: None for the next piece, or a special id
    for t in texts:
        parts: list[str | bytes] = [t]
        for s, packed in special:
            if s in t:
                parts = [q for p in parts for q in (_between(p, s, packed) if isinstance(p, str) else [p])]
        pieces += [p for p in parts if isinstance(p, str)]
        plan.append([None if isinstance(p, str) else p for p in parts])
    data, offsets, first = split_words(pieces)
    at = offsets.tolist()
    words = [data[a:b] for a, b in zip(at[:-1], at[1:])]
    if len(known) >= MAX_WORDS:
        known.clear()
    local = known
    new = sorted({w for w in words if w not in known})
    if len(known) + len(new) > 2 * MAX_WORDS:  # a slice of very many new words
        local = {}
        new = sorted(set(words))
    local.update(encode_words(new, vocab))
    encoded = iter([b"".join(map(local.__getitem__, words[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist())])
    return [b"".join(next(encoded) if p is None else p for p in parts) for parts in plan]


def _between(text: str, mark: str, packed: bytes) -> list[str | bytes]:
    out: list[str | bytes] = []
    for i, piece in enumerate(text.split(mark)):
        out += [packed, piece] if i else [piece]
    return out


def decode_ids(ids: bytes, path: str) -> str:
    """The text of ids as packed by ``encode_texts``; bytes that are not UTF-8 become U+FFFD."""
    table = _worker(path)[2]
    return b"".join(map(table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit).

    ``tokenizer`` is the path of a byte-level BPE file on every worker. Strings of special
    tokens inside a text become those tokens. Null text counts as empty and has no ids. Ids of
    rows are passed through, null or repeated; other columns are not read. An empty table
    gives no rows.

    Scale: no shuffle and nothing collected. A task holds one Arrow batch, a slice of
    ``SLICE_CHARS`` characters (or one text) with its words, and a bounded table of words.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = np.asarray(pc.binary_length(texts)).tolist()
            for a, b in slices(sizes, SLICE_CHARS):
                packed = encode_texts(texts.slice(a, b - a).to_pylist(), tokenizer)
                counts = np.array([len(p) // 4 for p in packed], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(counts), pa.array(packed, pa.binary())], names=[id_col, "n_tokens", "ids"])
        release(tokenizer)

    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("_text"))
    return rows.mapInArrow(work, f"`{id_col}` {id_type}, n_tokens long, ids binary")


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` plus ``text_col``, the text of the ids, special tokens included. Null ids give
    a null text. A column named ``text_col`` is replaced."""

    @F.pandas_udf("string")
    def text_of(ids):
        return ids.map(lambda x: None if x is None else decode_ids(x, tokenizer))

    return rows.withColumn(text_col, text_of(F.col(ids_col)))


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode, each text: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    The same as ``decode(encode(...))`` with the digests taken, in one pass over the texts,
    so that neither ids nor texts cross from Python to the JVM and back. Nulls, empty texts
    and repeated rows as in ``encode``.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = np.asarray(pc.binary_length(texts)).tolist()
            for a, b in slices(sizes, SLICE_CHARS):
                packed = encode_texts(texts.slice(a, b - a).to_pylist(), tokenizer)
                counts = np.array([len(p) // 4 for p in packed], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array(counts),
                        pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                        pa.array([hashlib.sha256(decode_ids(p, tokenizer).encode()).hexdigest() for p in packed]),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        release(tokenizer)

    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("_text"))
    return rows.mapInArrow(work, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
