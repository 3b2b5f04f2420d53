"""Substring dedup: recurring phrases are confirmed, compiled into sharded Aho-Corasick
automata over words, and every occurrence in all documents is located.

A window is ``WINDOW`` consecutive words. Of the hashes of the ``ANCHOR``-word sequences in a
window the smallest is the window's *anchor*; equal windows have equal anchors, and a text has
about one anchor in five words.

1. Candidates. Every document's anchors are counted; those of two or more documents, and the
   smallest document that has each, are joined back to the documents.
2. Segments. Stretches of a document whose windows all have a recurring anchor are cut out and
   sent to a shard, chosen by the anchor's smallest document. All windows with one anchor, so
   all that can be equal, are in one shard; one shared passage lies in one shard.
3. Confirmation. In each shard the windows that occur in two or more documents, and the
   smallest of these, are found by an aggregation; their words are taken from that document.
4. Location. Each shard's phrases are compiled into an automaton (pyahocorasick, over word
   numbers) through which the shard's segments are streamed. An occurrence in a document other
   than the smallest marks its words. A shard with many segments is dealt out by salt, with a
   copy of its phrases for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import maybe_broadcast, slices, stored, text_or_empty
from .word_hash import sequence_hashes, word_hashes

WINDOW, ANCHOR = 13, 6
#: Bytes worked on at once, recurring anchors for one shard, words of segments for one salt,
#: and bytes of marked ranges up to which they are sent to all executors.
SLICE_BYTES, SHARD_ANCHORS, SALT_WORDS, RANGE_BYTES = 2_000_000, 5_000, 500_000, 32 << 20


def window_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor of each window, index of its text, its first word in the text)."""
    words, first = word_hashes(texts)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = sequence_hashes(words, ANCHOR)
    anchors = grams[:n].copy()
    for j in range(1, WINDOW - ANCHOR + 1):
        np.minimum(anchors, grams[j : j + n], out=anchors)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    whole = text[:n] == text[WINDOW - 1 :]
    return anchors[whole], text[:n][whole], (np.arange(n) - first[text[:n]])[whole]


def _batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(np.asarray(pc.binary_length(batch.column(text))).tolist(), SLICE_BYTES):
            yield batch.slice(a, b - a)


def _raw(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, anchor), once for each document of a slice."""
    for batch in _batches(batches, 1):
        ids = np.asarray(batch.column(0))
        anchors, text, _ = window_anchors(_raw(batch.column(1)))
        if len(anchors):
            # equal anchors of a text mostly stand side by side; the rest goes in the aggregation
            new = np.append(True, (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[text[new]]), pa.array(anchors[new].view(np.int64))], names=["doc", "anchor"])


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of consecutive windows of one shard: (shard, doc, row, start, n_words, segment)."""
    for batch in _batches(batches, 2):
        out: list[tuple] = []
        raws = _raw(batch.column(2))
        anchors, text, start = window_anchors(raws)
        bounds = np.searchsorted(text, np.arange(len(raws) + 1))
        docs, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column(3)), 0)))
        known = batch.column(3).flatten()
        all_keys, all_shards = np.asarray(known.field(0)).view(np.uint64), np.asarray(known.field(1))
        for i, raw in enumerate(raws):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            if lo == hi:
                continue
            own = slice(int(ends[i - 1]) if i else 0, int(ends[i]))
            keys, shards = all_keys[own], all_shards[own]
            order = np.argsort(keys)
            at = np.minimum(np.searchsorted(keys, anchors[lo:hi], sorter=order), len(keys) - 1)
            shard = np.where(keys[order[at]] == anchors[lo:hi], shards[order[at]], -1)
            cuts = np.flatnonzero(np.diff(shard, prepend=-2))
            words = None
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)]):
                if shard[a] >= 0:
                    words = raw.split() if words is None else words
                    piece = words[a : b + WINDOW - 1]
                    out.append((int(shard[a]), docs[i], rows[i], a, len(piece), b" ".join(piece)))
        if out:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["shard", "doc", "row", "start", "n_words", "segment"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, window, doc, last) of the windows in segments, combined within a slice."""
    for batch in _batches(batches, 2):
        words, first = word_hashes(_raw(batch.column(2)))
        hashes = sequence_hashes(words, WINDOW)
        text = np.repeat(np.arange(batch.num_rows), np.diff(first))
        whole = text[: len(hashes)] == text[WINDOW - 1 :]
        shard, doc = np.asarray(batch.column(0))[text[: len(hashes)][whole]], np.asarray(batch.column(1))[text[: len(hashes)][whole]]
        hashes = hashes[whole].view(np.int64)
        order = np.lexsort((doc, hashes, shard))
        shard, hashes, doc = shard[order], hashes[order], doc[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (shard[1:] != shard[:-1])) if len(hashes) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        last = doc[np.append(at[1:], len(doc)) - 1] if len(at) else doc[:0]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard[at], hashes[at], doc[at], last)], names=["shard", "window", "doc", "last"])


def _phrase_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, doc, passage): runs of a segment's words whose windows are all confirmed with
    this document as their smallest."""
    for batch in batches:
        out = []
        for shard, doc, raw, windows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _raw(batch.column(2)), batch.column(3)):
            words = raw.split()
            hashes = sequence_hashes(word_hashes([raw])[0], WINDOW).view(np.int64)
            good = np.isin(hashes, np.asarray(windows.values))
            edges = np.flatnonzero(np.diff(good.astype(np.int8), prepend=0, append=0))
            out += [(shard, doc, b" ".join(words[a : b + WINDOW - 1])) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary()))], names=["shard", "doc", "passage"])


def compile_phrases(passages: list[tuple[int, bytes]]) -> tuple[tuple[ahocorasick.Automaton, list[int]], dict[bytes, int]]:
    """An automaton over word numbers whose phrases are the windows of the passages, the
    documents that its values stand for (of each phrase the smallest given), and the numbers
    (0: a word of no phrase)."""
    numbers: dict[bytes, int] = {}
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    first: dict[tuple[int, ...], int] = {}
    for doc, raw in passages:
        ids = tuple(numbers.setdefault(w, len(numbers) + 1) for w in raw.split())
        for i in range(len(ids) - WINDOW + 1):
            phrase = ids[i : i + WINDOW]
            if first.get(phrase, doc + 1) > doc:
                first[phrase] = doc
    docs = sorted(set(first.values()))
    at = {d: i for i, d in enumerate(docs)}
    for phrase, doc in first.items():
        machine.add_word(phrase, at[doc])
    if first:
        machine.make_automaton()
    return (machine, docs), numbers


def occurrences(compiled: tuple, numbers: dict[bytes, int], raw: bytes) -> list[tuple[int, int]]:
    """(last word, value) of each phrase that occurs in a segment."""
    machine, docs = compiled
    return list(machine.iter(tuple(map(numbers.get, raw.split(), repeat(0))))) if docs else []


def covered(docs: list[int], found: list[tuple[int, int]], doc: int) -> list[tuple[int, int]]:
    """Ranges of words covered by the found phrases whose smallest document is before ``doc``."""
    out: list[tuple[int, int]] = []
    for end, k in found:
        if docs[k] < doc:
            a, b = end - WINDOW + 1, end + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def locate(compiled: tuple, numbers: dict[bytes, int], doc: int, raw: bytes) -> list[tuple[int, int]]:
    """Ranges of words covered by phrases whose smallest document is before ``doc``."""
    return covered(compiled[1], occurrences(compiled, numbers, raw), doc)


def _locate_group(phrases: pa.Table, segments: pa.Table) -> pa.Table:
    compiled, numbers = compile_phrases(list(zip(phrases.column("doc").to_pylist(), phrases.column("passage").to_pylist())))
    out = []
    # a passage that documents share whole is streamed through the automaton once for all of them
    rows = sorted(zip(*(segments.column(c).to_pylist() for c in ("segment", "doc", "row", "start"))))
    before, found = None, []
    for raw, doc, row, start in rows:
        if raw != before:
            before, found = raw, occurrences(compiled, numbers, raw)
        out += [(doc, row, start + a, start + b) for a, b in covered(compiled[1], found, doc)]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    columns = list(zip(*out)) or [()] * 4
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc", "row", "first", "end"])


def _kept_rows(with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, 1):
            n_words, n_removed, kept = [], [], []
            for raw, ranges in zip(_raw(batch.column(1)), batch.column(2).to_pylist()):
                words = raw.split()
                n_words.append(len(words))
                if ranges:
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    for r in ranges:
                        gone[r["first"]] += 1
                        gone[r["end"]] -= 1
                    stays = np.cumsum(gone)[:-1] == 0
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            column = pa.array(kept, pa.binary()).cast(pa.string()) if with_text else pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), column], names=["_id", "n_words", "n_removed", "_kept"]
            )

    return work


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per input row: id (long), ``n_words``, ``n_removed`` and ``kept_text``, the
    words that stay joined by one space, or with ``digest`` its ``kept_sha256``.

    A word goes if a window that covers it also starts in a document with a smaller id;
    windows are judged on the input. Null text counts as empty; texts of fewer words than a
    window lose none. A row with a null id loses nothing and takes nothing from others. Rows
    repeated with one id are one document: they take nothing from each other. Other columns
    are not read. An empty table gives no rows.

    Scale: anchors, not windows, of all documents are shuffled, texts once to meet their
    recurring anchors (and once more if the marked ranges are too large to send to all
    executors), after that only segments. All groups are combined before a shuffle
    or dealt out by salt, and what comes back to a document (marked ranges) is bounded by its
    length. Intermediates are written to the shared folder.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    named = rows.filter("doc IS NOT NULL")

    # 1. anchors of two or more documents
    anchors = named.mapInArrow(_anchor_rows, "doc long, anchor long")
    recurring = stored(
        anchors.groupBy("anchor").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("anchor", "first"), "anchors"
    )
    n_shards = max(1, -(-recurring.count() // SHARD_ANCHORS))
    shard = F.pmod(F.xxhash64("first"), F.lit(n_shards)).cast("int").alias("shard")
    mine = anchors.join(recurring, "anchor").select("doc", "anchor", shard)
    lists = stored(mine.groupBy("doc").agg(F.collect_set(F.struct("anchor", "shard")).alias("anchors")), "doc-anchors")

    # 2. segments; most documents of a corpus share some phrase, so ids are not looked up first
    chosen = named.select("doc", F.xxhash64("text").alias("row"), "text")
    segments = stored(
        chosen.join(lists, "doc").select("doc", "row", "text", "anchors").mapInArrow(
            _segment_rows, "shard int, doc long, row long, start int, n_words int, segment binary"
        ),
        "segments",
    )

    # 3. confirmation
    windows = segments.select("shard", "doc", "segment").mapInArrow(_window_rows, "shard int, window long, doc long, last long")
    confirmed = windows.groupBy("shard", "window").agg(F.min("doc").alias("doc"), F.max("last").alias("last")).filter("doc < last")
    by_doc = confirmed.groupBy("shard", "doc").agg(F.collect_list("window").alias("windows"))
    passages = stored(
        segments.select("shard", "doc", "segment").distinct().join(by_doc, ["shard", "doc"]).select("shard", "doc", "segment", "windows").mapInArrow(
            _phrase_rows, "shard int, doc long, passage binary"
        ),
        "passages",
    )

    # 4. location
    load = segments.groupBy("shard").agg(F.ceil(F.sum("n_words") / SALT_WORDS).cast("int").alias("salts"))
    load = stored(load.join(passages.select("shard").distinct(), "shard", "left_semi"), "shards")
    n_load = load.count()
    salted = segments.join(maybe_broadcast(load, n_load), "shard").withColumn("salt", F.pmod(F.xxhash64("doc", "start"), F.col("salts")).cast("int"))
    copies = passages.join(maybe_broadcast(load, n_load), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    ranges = (
        copies.select("shard", "salt", "doc", "passage").groupBy("shard", "salt")
        .cogroup(salted.select("shard", "salt", "doc", "row", "start", "segment").groupBy("shard", "salt"))
        .applyInArrow(_locate_group, "doc long, row long, first int, end int")
    )
    marked = stored(ranges.groupBy("doc", "row").agg(F.collect_list(F.struct("first", "end")).alias("ranges")), "ranges")
    n_docs, n_ranges = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ranges")), F.lit(0))).first()
    small = 32 * n_docs + 24 * n_ranges <= RANGE_BYTES
    keyed = rows.withColumn("row", F.xxhash64("text"))
    out = keyed.join(F.broadcast(marked) if small else marked, ["doc", "row"], "left").select("doc", "text", "ranges")
    out = out.mapInArrow(_kept_rows(not digest), "_id long, n_words long, n_removed long, _kept string")
    return out.select(F.col("_id").alias(id_col), "n_words", "n_removed", F.col("_kept").alias("kept_sha256" if digest else "kept_text"))
