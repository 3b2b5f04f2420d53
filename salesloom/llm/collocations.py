"""Phrase collocations: frequent word sequences, found with Misra-Gries summaries.

First pass: every sequence is hashed to 64 bits, and the hash space is cut into partitions. A
task sums what it has seen and sends each partition its share: a summary and the mass
(occurrences) behind it. The partition's task adds up the masses first, so it knows its
capacity, ``mass // threshold + 1`` counters. When the merged summary holds more, the largest
count beyond the capacity is taken off all counters (Agarwal et al., Mergeable Summaries). Each
such step takes that much off more than ``mass / threshold`` counters, so all steps together
take less than the threshold off any of them, and every frequent sequence keeps a counter. Single
words go first; a phrase is not more frequent than any of its words, so phrases are summed up
only where all words may be frequent.

Second pass: the survivors' hashes are bitmaps of bounded size; texts are read again, and the
sequences that these let through are counted exactly, as text. What they let through beside
(collisions, counters that survived by the error) falls to the exact threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import give_back, maybe_broadcast, slices, stored, text_batches, text_or_empty
from .word_hash import _powers, mix, sequence_hashes

#: Longest phrase in words.
MOST_WORDS = 4
#: Bytes of text worked on at once; counters a task sums up before it sends them, and sends in
#: one piece; counters that a partition's task merges before it cuts them to its capacity.
SLICE_BYTES, SEND, PIECE, MERGE = 1_000_000, 1_000_000, 200_000, 1_000_000
#: The bitmap has 128 bits for each survivor, from 2^16 up to 2^29 (64 MB).
MOST_BITS = 29
#: Distinct phrases that a task of the second pass sums up before it sends or returns them.
PHRASES = 250_000

_SPACE, _BREAK = 0x20, 0x0A
#: A-Z in lower case, the other white space as a space, and all that ends a piece as a break.
_MAP = bytes(_SPACE if b == 0x09 else _BREAK if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class Bitmap:
    """A set of hashes by their leading bits; it may have others beside."""

    def __init__(self, filled: bytes, bits: int):
        self._bytes, self._shift = np.frombuffer(filled, np.uint8), np.uint64(64 - bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> self._shift
        return (self._bytes[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Words:
    """The words of some texts: their bytes with single spaces, borders, pieces and texts."""

    def __init__(self, texts: list[bytes]):
        raw = b"\n".join(texts).translate(_MAP) + b"\n"
        data = np.frombuffer(raw, np.uint8)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        twice = (data[1:] == _SPACE) & (data[:-1] == _SPACE)
        if twice.any():
            keep = np.concatenate([[True], ~twice])
            begins = np.concatenate([[0], np.cumsum(keep)])[begins]
            data = data[keep]
        self.data = data
        solid = (data != _SPACE) & (data != _BREAK)
        before = np.concatenate([[False], solid[:-1]])
        self.starts, self.ends = np.flatnonzero(solid & ~before), np.flatnonzero(before & ~solid)
        self.piece = np.cumsum(data == _BREAK)[self.starts]
        self.text = np.searchsorted(begins, self.starts, "right") - 1

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        up, down = _powers(1 << max(16, n.bit_length()))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def grams(self, salts: np.ndarray, sizes: range, of: Bitmap | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, index of first word, hash) of the sequences of n words within pieces, for each n
        of ``sizes``; with ``of`` only those whose words are all in it. ``salts`` has a number
        for the group of each text."""
        words = self.hashes()
        salted = lambda n, at: mix((sequence_hashes(words, n)[at] ^ salts[self.text[at]]) + np.uint64(n))
        out = np.zeros(len(words) + 1, np.int64)  # words before each that are not in ``of``
        if of is not None and len(words):
            np.cumsum(~of.has(salted(1, np.arange(len(words)))), out=out[1:])
        for n in sizes:
            if len(words) < n:
                return
            last = len(words) - n + 1
            at = np.flatnonzero((self.piece[:last] == self.piece[n - 1 :]) & (out[:last] == out[n:]))
            yield n, at, salted(n, at)

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The texts of the sequences of n words from ``at``, joined by single spaces."""
        begin, size = self.starts[at].astype(np.int64), (self.ends[at + n - 1] - self.starts[at]).astype(np.int64)
        ends = np.cumsum(size)
        flat = self.data[np.arange(size.sum()) + np.repeat(begin - (ends - size), size)]
        bounds = np.concatenate([[0], ends]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(flat))


def _salt(group: str) -> int:
    return int.from_bytes(sha256(group.encode()).digest()[:8], "little")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, list[str], np.ndarray]]:
    """(words, group's number of each text, groups, salt of each text), slice by slice."""
    for batch in batches:
        coded = batch["group"].dictionary_encode()
        groups = coded.dictionary.to_pylist()
        codes, salts = np.asarray(coded.indices), np.array([_salt(g) for g in groups], np.uint64)
        texts = batch["text"].cast(pa.large_string()).cast(pa.large_binary())
        for a, b in slices(np.asarray(pc.binary_length(texts)).tolist(), SLICE_BYTES):
            yield Words(texts.slice(a, b - a).to_pylist()), codes[a:b], groups, salts[codes[a:b]]


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and the sums of their counts."""
    order = np.argsort(hashes)
    hashes = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)])
    return hashes[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.sort(hashes)
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)])
    return hashes[first], np.diff(np.append(first, len(hashes))).astype(np.int64)


class MisraGries:
    """Counters of at most ``capacity`` hashes; ``removed`` is the most that any count lacks."""

    def __init__(self, capacity: int):
        self.capacity, self.removed = capacity, 0
        self._parts: list[tuple[np.ndarray, np.ndarray]] = []
        self._held = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self._parts.append((hashes, counts))
        self._held += len(hashes)
        if self._held > MERGE + self.capacity:
            self.cut()

    def _merge(self) -> tuple[np.ndarray, np.ndarray]:
        hashes, counts = _summed(np.concatenate([h for h, _ in self._parts]), np.concatenate([c for _, c in self._parts]))
        self._parts, self._held = [(hashes, counts)], len(hashes)
        return hashes, counts

    def cut(self) -> None:
        """Sum up; if more than ``capacity`` counters are left, take the largest count beyond it
        off all, and drop those that it empties."""
        hashes, counts = self._merge()
        beyond = len(counts) - self.capacity
        if beyond > 0:
            least = int(np.partition(counts, beyond - 1)[beyond - 1])
            keep = counts > least
            self.removed += least
            self._parts, self._held = [(hashes[keep], counts[keep] - least)], int(keep.sum())

    def survivors(self, threshold: int) -> np.ndarray:
        """Hashes that may have been seen ``threshold`` times; all that have been are among them."""
        if not self._parts:
            return np.zeros(0, np.uint64)
        hashes, counts = self._merge()
        return hashes[counts + self.removed >= threshold]


_SUMMARY = "p int, seq int, mass long, hashes binary, counts binary"
_SUMMARY_ARROW = pa.schema([("p", pa.int32()), ("seq", pa.int32()), ("mass", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _planes(ascending: np.ndarray) -> bytes:
    """Differences of 64-bit integers, byte by byte: leading zeros end up together, and the
    shuffle's compression takes them out."""
    steps = np.diff(ascending, prepend=ascending.dtype.type(0))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(cell: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(cell, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The hash partition, ascending with the hash."""
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)


def _share(hashes: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows for the hash partitions: each one's mass (seq 0) and its summary (seq 1)."""
    p = _part_of(hashes, parts)
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    bounds = np.append(first, len(p)).tolist()
    mass = np.add.reduceat(counts, first).tolist()
    for a, b in slices(np.diff(bounds).tolist(), PIECE):
        rows = [{"p": int(p[bounds[i]]), "seq": 0, "mass": mass[i]} for i in range(a, b)]
        for i in range(a, b):
            own = slice(bounds[i], bounds[i + 1])
            rows.append({"p": int(p[bounds[i]]), "seq": 1, "mass": 0, "hashes": _planes(hashes[own]), "counts": _planes(np.cumsum(counts[own]))})
        yield pa.RecordBatch.from_pylist(rows, schema=_SUMMARY_ARROW)


def survivors(texts: DataFrame, threshold: int, parts: int, sizes: range, of: tuple[bytes, int] | None = None) -> DataFrame:
    """First pass: (p, hash) of all sequences of (group, text), of ``sizes`` words, that may be
    that frequent; with ``of``, the bitmap of single words, of those whose words are all in it."""
    shared = of and texts.sparkSession.sparkContext.broadcast(of)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, allowed = 0, shared and Bitmap(*shared.value)
        for words, _, _, salts in _texts(batches):
            found = [h for _, _, h in words.grams(salts, sizes, allowed) if len(h)]
            if not found:
                continue
            held.append(_counted(np.concatenate(found)))
            size += len(held[-1][0])
            if size > SEND:
                held = [_summed(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > SEND // 2:
                    yield from _share(*held.pop(), parts)
                    size = 0
        if size:
            held = [_summed(*map(np.concatenate, zip(*held)))]
            yield from _share(*held.pop(), parts)
        give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mass, summary = -1, 0, MisraGries(1)

        def found() -> pa.RecordBatch:
            hashes = summary.survivors(threshold).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), now, np.int32)), pa.array(hashes)], names=["p", "hash"])

        for batch in batches:
            for p, seq, more, hashes, counts in zip(batch["p"].to_pylist(), batch["seq"].to_pylist(), batch["mass"].to_pylist(), batch["hashes"], batch["counts"]):
                if p != now:
                    if now >= 0:
                        yield found()
                    now, mass, summary = p, 0, MisraGries(1)
                if seq == 0:
                    mass += more
                else:
                    summary.capacity = mass // threshold + 1
                    totals = _from_planes(counts.as_py()).view(np.int64)
                    summary.add(_from_planes(hashes.as_py()), np.diff(totals, prepend=0))
        if now >= 0:
            yield found()
        del summary
        give_back()

    shares = texts.mapInArrow(send, _SUMMARY)
    tasks = max(1, parts // 4)
    return shares.repartition(tasks, "p").sortWithinPartitions("p", "seq").mapInArrow(merge, "p int, hash long")


def bitmap(found: DataFrame) -> tuple[bytes, int]:
    """The hashes as a bitmap over their leading bits, and the number of those bits."""
    bits = min(MOST_BITS, max(16, int(128 * found.count()).bit_length()))
    at = F.shiftrightunsigned("hash", 64 - bits) + 1
    rows = found.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = bytearray(1 << bits - 3)
    for r in rows:
        begin = (r["b"] - 1) * 4096
        out[begin : begin + 4096] = bytes(r["bits"])[: len(out) - begin]
    return bytes(out), bits


def count_phrases(texts: DataFrame, words: tuple[bytes, int], phrases: tuple[bytes, int], threshold: int, parts: int) -> DataFrame:
    """Second pass: (group, size, phrase, n), exact counts of the sequences with ``threshold``
    occurrences or more, by the bitmaps of single words and of phrases; size 0 has a group's
    words."""
    shared = texts.sparkSession.sparkContext.broadcast((words, phrases))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, several = (Bitmap(*x) for x in shared.value)
        held: list[pa.Table] = []
        for words, codes, groups, salts in _texts(batches):
            names = pa.array(groups, pa.large_string())
            totals = np.bincount(codes[words.text], minlength=len(groups))
            own = np.array([_salt(g) for g in groups], np.uint64)
            held.append(_rows(own, names, pa.array([""] * len(groups), pa.large_string()), totals, 0))
            for n, at, hashes in words.grams(salts, range(1, MOST_WORDS + 1), single):
                if n > 1:
                    stay = several.has(hashes)
                    at, hashes = at[stay], hashes[stay]
                coded = words.phrases(at, n).dictionary_encode()
                pairs, first, times = np.unique(np.asarray(coded.indices).astype(np.int64) * len(groups) + codes[words.text[at]], return_index=True, return_counts=True)
                held.append(_rows(hashes[first], names.take(pa.array(pairs % len(groups))), coded.dictionary.take(pa.array(pairs // len(groups))), times, n))
            if sum(t.num_rows for t in held) > 2 * PHRASES:
                held = [_together(held)]
                if held[0].num_rows > PHRASES:
                    yield from _dealt(held.pop(), parts)
        if held:
            held = [_together(held)]
            yield from _dealt(held.pop(), parts)
        give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(_undealt(batch))
            last = batch["p"][-1].as_py()
            if sum(t.num_rows for t in held) > 2 * PHRASES:
                held = [_together(held)]
                done = pc.less(held[0]["p"], last)  # the last partition may go on in the next batch
                yield from _frequent(held[0].filter(done), threshold)
                held = [held[0].filter(pc.invert(done))]
        if held:
            held = [_together(held)]
            yield from _frequent(held.pop(), threshold)
        give_back()

    dealt = texts.mapInArrow(work, "p int, group string, phrases binary, counts binary")
    dealt = dealt.repartition(max(1, parts // 4), "p").sortWithinPartitions("p")
    return dealt.mapInArrow(merge, "group string, size int, phrase string, n long")


def _rows(hashes: np.ndarray, group: pa.Array, phrase: pa.Array, n: np.ndarray, size: int) -> pa.Table:
    return pa.table({"p": hashes, "group": group, "size": pa.array(np.full(len(n), size, np.int32)), "phrase": phrase, "n": pa.array(n.astype(np.int64))})


def _together(held: list[pa.Table]) -> pa.Table:
    """Equal phrases summed up; ``p`` is their hash, later their partition."""
    keys = ["p", "group", "size", "phrase"]
    summed = pa.concat_tables(held).group_by(keys).aggregate([("n", "sum")])
    return summed.rename_columns({"n_sum": "n"}).select([*keys, "n"]).combine_chunks()


def _dealt(table: pa.Table, parts: int) -> Iterator[pa.RecordBatch]:
    """A row for each hash partition and group: its phrases in order, which makes them short
    when compressed, and their counts."""
    table = table.set_column(0, "p", pa.array(_part_of(np.asarray(table["p"]), parts)))
    table = table.sort_by([("p", "ascending"), ("group", "ascending"), ("phrase", "ascending")]).combine_chunks()
    p, group = np.asarray(table["p"]), np.asarray(table["group"].combine_chunks().dictionary_encode().indices)
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (group[1:] != group[:-1])])
    bounds = np.append(np.flatnonzero(new), len(p))
    phrases, counts = table["phrase"].chunk(0).cast(pa.string()), np.asarray(table["n"])
    pack = zstandard.ZstdCompressor(level=3).compress
    for a, b in slices(np.diff(bounds).tolist(), PIECE):
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds[a : b + 1].astype(np.int32)), phrases), "\n")
        cells = [_planes(np.cumsum(counts[bounds[i] : bounds[i + 1]])) for i in range(a, b)]
        at = pa.array(bounds[a:b])
        yield pa.RecordBatch.from_arrays(
            [pa.array(p[bounds[a:b]]), table["group"].chunk(0).take(at).cast(pa.string()), pa.array([pack(x.as_buffer()) for x in joined], pa.binary()), pa.array(cells, pa.binary())],
            names=["p", "group", "phrases", "counts"],
        )


def _undealt(batch: pa.RecordBatch) -> pa.Table:
    """Phrases have single spaces and no line ends; the empty one is a group's total."""
    unpack = zstandard.ZstdDecompressor().decompress
    counts = [np.diff(_from_planes(c.as_py()).view(np.int64), prepend=0) for c in batch["counts"]]
    phrases = pc.split_pattern(pa.array([unpack(c.as_buffer()) for c in batch["phrases"]], pa.large_binary()).cast(pa.large_string()), "\n").flatten()
    times = pa.array(np.repeat(np.arange(batch.num_rows), [len(c) for c in counts]))
    size = pc.if_else(pc.equal(phrases, ""), 0, pc.add(pc.count_substring(phrases, " ").cast(pa.int32()), pa.scalar(1, pa.int32()))).cast(pa.int32())
    return pa.table({"p": batch["p"].take(times), "group": batch["group"].cast(pa.large_string()).take(times), "size": size, "phrase": phrases, "n": pa.array(np.concatenate(counts))})


def _frequent(table: pa.Table, threshold: int) -> Iterator[pa.RecordBatch]:
    stay = pc.or_(pc.greater_equal(table["n"], threshold), pc.equal(table["size"], 0))
    kept = table.filter(stay).drop_columns(["p"])
    return iter(kept.cast(pa.schema([("group", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=100_000))


def _big(col: str) -> Column:
    return F.col(col).cast("decimal(20,0)")


def collocations(docs: DataFrame, group_col: str = "lang", text_col: str = "text", threshold: int = 30, most: int = 2_000, share: int = 80, no_group: str = "und") -> DataFrame:
    """The strongest phrases of two to four words of each group: ``group_col``, ``rank``,
    ``phrase``, ``a`` (its occurrences), ``l`` and ``r`` (those of its two parts), ``n`` (the
    group's words) and ``score``.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and into words at
    spaces and tabs; occurrences within pieces count, overlaps included. Candidates occur
    ``threshold`` times or more. A cut after k words has the score 2000000 a / (l + r), rounded
    down; the cut with the lowest score counts, of equal ones the one with the smallest k. A
    candidate is dropped if a longer one that contains it has ``share`` percent of its
    occurrences or more. The first ``most`` of a group by score, a (both descending) and phrase
    (as UTF-8 bytes) are returned.

    A null group is ``no_group``; null and empty texts have no words; repeated rows count as
    often as they stand there. An empty table gives no rows. Other columns are not read.

    Scale: texts are read three times, for words, phrases and exact counts. What is shuffled are
    hashes and counts summed by task, at last the phrases that passed a bitmap of at most 64 MB.
    Counters of a hash
    partition are bounded by its mass over the threshold; no group is ever in one task: the
    ranking takes the first rows of each share of a group before they meet.
    """
    spark = docs.sparkSession
    text_batches(spark)
    texts = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit(no_group)).alias("group"), text_or_empty(text_col).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = bitmap(stored(survivors(texts, threshold, parts, range(1, 2)), "frequent-words"))
    phrases = bitmap(stored(survivors(texts, threshold, parts, range(2, MOST_WORDS + 1), words), "frequent-phrases"))
    counts = stored(count_phrases(texts, words, phrases, threshold, parts), "phrases")
    return _ranked(_scored(counts, share), counts, group_col, most)


def _scored(counts: DataFrame, share: int) -> DataFrame:
    """Candidates that no longer one stands for, with their lowest-scoring cut."""
    whole = counts.filter("size >= 2").select("group", "size", "phrase", F.col("n").alias("a"))
    part = lambda begin, length: F.array_join(F.slice(F.split("phrase", " "), begin, length), " ")
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("group", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    parts = counts.filter("size >= 1")
    cuts = cuts.join(parts.select("group", F.col("phrase").alias("first"), F.col("n").alias("l")), ["group", "first"])
    cuts = cuts.join(parts.select("group", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["group", "rest"])
    cuts = cuts.select("*", (_big("a") * 2_000_000).alias("_top"), (_big("l") + _big("r")).alias("_under")).withColumn("score", F.expr("_top div _under"))
    best = cuts.groupBy("group", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = whole.filter("size >= 3").withColumn("length", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("begin", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)))
    inner = inner.select("group", part(F.col("begin"), F.col("length")).alias("phrase"), "a").groupBy("group", "phrase").agg(F.max("a").alias("longer"))
    best = best.join(inner, ["group", "phrase"], "left")
    covered = _big("longer") * 100 >= _big("a") * share
    return best.filter(F.col("longer").isNull() | ~covered).select("group", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _ranked(scored: DataFrame, counts: DataFrame, group_col: str, most: int) -> DataFrame:
    """The first of each share of a group, then the first of these."""
    by = [F.desc("score"), F.desc("a"), F.col("phrase")]
    shares = min(1_024, max(16, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    first = scored.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    first = first.withColumn("_place", F.row_number().over(Window.partitionBy("group", "_share").orderBy(*by))).filter(F.col("_place") <= most)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(*by)).cast("long")).filter(F.col("rank") <= most)
    totals = counts.filter("size = 0").select("group", F.col("n"))
    return first.join(maybe_broadcast(totals, totals.count()), "group").select(F.col("group").alias(group_col), "rank", "phrase", "a", "l", "r", "n", "score")
