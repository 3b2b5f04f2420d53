"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banded, and
verified by weighted Jaccard similarity.

A text is a weighted set of its five-word shingles. The weight of a shingle is its number in
the text times an inverse document frequency, ``1 + min(1, ln(N / df) / ln(1 / HEAVY))``: 2 for
all but the shingles that more than a share ``HEAVY`` of the documents have, and down to 1 for
one that all have. So only frequent shingles need counting, and a passage that very many
documents share counts half as much as what is their own, at any size of the corpus.

1. Frequent shingles: candidates come from blocks of documents (a shingle of a share of all
   documents has that share in some block) and are then counted over all documents.
2. Texts with the same weighted set are one *member*, stood for by the smallest id.
3. Screening: a short signature (``SCREEN`` bands) of every document; members that share a
   band with no other are done. The others get a long signature (``BANDS``).
4. In two rounds each bucket of equal band keys gets a leader, which is compared with all
   members of its bucket that are not yet in its class. Every hit is a link, and classes are
   the connected components of the links. A bucket whose members are of one class is finished:
   a bucket of n copies costs n comparisons, not n squared.
5. Buckets that still have members of several classes are taken together to sets of members,
   and these are dealt out to blocks of ``MEMBERS``. A task compares one block with another, by
   a product of matrices, and emits only the links that hold similar members together. So no two members of a bucket stay in
   different classes uncompared, and no pair that is not a link becomes a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import give_back, maybe_broadcast, slices, stored, text_batches, text_or_empty
from .components import components
from .word_hash import mix, sequence_hashes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Share of documents from which a shingle's weight falls.
HEAVY = 1 / 64
#: (bands, rows) of the screening and of the long signature. At similarity 0.8 a pair is in
#: some common bucket with probability 0.999 in either.
SCREEN, BANDS = (10, 3), (40, 8)
#: Bytes worked on at once; shingles of a block of documents; candidate rows that may be
#: broadcast; bands of the first round; members of a block, and columns of a matrix.
SLICE_BYTES, BLOCK, CANDIDATES, FIRST_BANDS, MEMBERS, COLUMNS = 500_000, 3_000_000, 500_000, 4, 256, 4096

#: A-Z lower-cased, other ASCII characters but digits and letters made spaces.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle hash, count), sorted by text and hash. A text of fewer words than
    a shingle has one shingle, of all its words; a text without words has none."""
    words, first = word_hashes([t.translate(_FOLD) for t in texts])
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    grams = sequence_hashes(words, SHINGLE)
    n = len(grams)
    whole = text[:n] == text[SHINGLE - 1 :] if n else np.zeros(0, bool)
    grams, owner = grams[whole], text[:n][whole]
    short = [i for i, k in enumerate(np.diff(first).tolist()) if 0 < k < SHINGLE]
    if short:
        own = [sequence_hashes(words[first[i] : first[i + 1]], int(first[i + 1] - first[i])) for i in short]
        grams, owner = np.concatenate([grams, *own]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    if not len(grams):
        return owner, grams, np.zeros(0, np.int64)
    new = np.flatnonzero(np.append(True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])))
    return owner[new], grams[new], np.diff(np.append(new, len(grams)))


def weights_of(grams: np.ndarray, counts: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Count times inverse document frequency; ``heavy``: sorted hashes and their factors."""
    keys, factors = heavy
    idf = np.full(len(grams), 2.0)
    if len(keys) and len(grams):
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        hit = keys[at] == grams
        idf[hit] = factors[at[hit]]
    return counts * idf


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) and their logarithms, at 4096 even steps."""
    p = (np.arange(4096) + 0.5) / 4096
    lo, hi = np.zeros(4096), np.full(4096, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return lo, np.log(lo)


def samples(grams: np.ndarray, weights: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """``k`` consistent weighted samples of each set (rows ``starts[i]`` up to the next):
    equal in two sets with the probability of their weighted Jaccard similarity.

    For each shingle and sample, r and c are drawn from Gamma(2, 1) and b from [0, 1) by the
    shingle's hash; t = floor(ln w / r + b), and the shingle with the least
    ln a = ln c - r (t - b + 1) is taken, with its t.
    """
    gamma, log_gamma = _tables()
    log_w = np.log(weights)
    sizes = np.diff(np.append(starts, len(grams)))
    out = np.empty((len(starts), k), dtype=np.uint64)
    seeds = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for j in range(k):
        x = mix(grams ^ seeds[j])
        r = gamma[(x & np.uint64(4095)).view(np.int64)]
        log_c = log_gamma[((x >> np.uint64(12)) & np.uint64(4095)).view(np.int64)]
        b = (x >> np.uint64(24)).view(np.int64) * 2.0**-40
        t = np.floor(log_w / r + b)
        a = log_c - r * (t - b + 1.0)
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == np.repeat(least, sizes))
        if len(at) > len(starts):  # ties: the smallest hash
            at = at[np.unique(np.searchsorted(starts, at, side="right"), return_index=True)[1]]
        out[:, j] = mix(grams[at] + t[at].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def band_keys(sampled: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each set and band of ``rows`` samples."""
    keys = np.empty((len(sampled), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(sampled), b + 1, dtype=np.uint64)
        for j in range(b * rows, (b + 1) * rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sampled[:, j])
        keys[:, b] = key
    return keys.view(np.int64)


def _raw(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _batches(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, tuple]]:
    for batch in batches:
        for a, b in slices(np.asarray(pc.binary_length(batch.column(text))).tolist(), SLICE_BYTES):
            part = batch.slice(a, b - a)
            yield part, shingles(_raw(part.column(text)))
    give_back()


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that a share ``HEAVY`` of a block's documents have, for each block."""
    held: list[np.ndarray] = []
    docs = 0

    def candidates() -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found[n >= HEAVY * docs].view(np.int64))], names=["gram"])

    for part, (_, grams, _) in _batches(batches, 0):
        held.append(grams)
        docs += part.num_rows
        if sum(map(len, held)) >= BLOCK:
            yield candidates()
            held, docs = [], 0
    if held:
        yield candidates()


def heavy_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and weight factors of the shingles that more than a share ``HEAVY`` of the
    rows of ``texts`` (one column) have. There are at most 1 / HEAVY times as many as a
    document has distinct shingles on average; only these reach the driver."""
    total = texts.count()
    wanted = stored(texts.mapInArrow(_block_rows, "gram long").distinct(), "heavy-candidates")
    n = wanted.count()
    if n <= CANDIDATES:
        listed = texts.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in wanted.collect()], dtype=np.int64).view(np.uint64)))

        def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = listed.value
            found = np.zeros(len(keys) + 1, dtype=np.int64)
            for _, (_, grams, _) in _batches(batches, 0):
                if len(keys) and len(grams):
                    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                    np.add.at(found, at[keys[at] == grams], 1)
            some = np.flatnonzero(found[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(found[some])], names=["gram", "n"])

        rows = texts.mapInArrow(counts, "gram long, n long")
    else:

        def ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, (_, grams, _) in _batches(batches, 0):
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(np.ones(len(grams), np.int64))], names=["gram", "n"])

        rows = texts.mapInArrow(ones, "gram long, n long").join(wanted, "gram", "left_semi")
    found = rows.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > HEAVY * total).collect()
    found = sorted((r[0] % (1 << 64), r[1]) for r in found)
    keys = np.array([g for g, _ in found], dtype=np.uint64)
    share = np.array([c for _, c in found], dtype=float) / max(1, total)
    return keys, 1 + np.minimum(1, np.log(1 / np.maximum(share, 1e-300)) / math.log(1 / HEAVY)) if len(keys) else share


def _signature_rows(heavy):
    """(doc, key1, key2, n, bands): the weighted set's identity, its size, the screening keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (owner, grams, counts) in _batches(batches):
            n = np.bincount(owner, minlength=part.num_rows)
            has = np.flatnonzero(n)
            starts = np.searchsorted(owner, has)
            keys = np.zeros((2, part.num_rows), dtype=np.uint64)
            bands = np.zeros((part.num_rows, SCREEN[0]), dtype=np.int64)
            if len(has):
                one = mix(grams + mix(counts.astype(np.uint64)))
                keys[0, has] = np.add.reduceat(one, starts)
                keys[1, has] = np.add.reduceat(mix(one ^ np.uint64(0xA0761D6478BD642F)), starts)
                bands[has] = band_keys(samples(grams, weights_of(grams, counts, heavy.value), starts, SCREEN[0] * SCREEN[1]), *SCREEN)
            listed = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * SCREEN[0], pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(n.astype(np.int32)), listed],
                names=["doc", "key1", "key2", "n", "bands"],
            )

    return work


def _member_rows(heavy):
    """(member, total, bands, grams, weights, counts): the long signature, and the weighted set
    packed for verification (32 bits of each hash, sorted, with weights and counts)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (owner, grams, counts) in _batches(batches):
            n = np.bincount(owner, minlength=part.num_rows)
            has = np.flatnonzero(n)
            if not len(has):
                continue
            starts = np.searchsorted(owner, has)
            weights = weights_of(grams, counts, heavy.value)
            bands = band_keys(samples(grams, weights, starts, BANDS[0] * BANDS[1]), *BANDS)
            ends = np.append(starts[1:], len(grams))
            high, light, times = (grams >> np.uint64(32)).astype("<u4"), weights.astype("<f4"), counts.astype("<u4")
            ids = part.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in has], pa.int64()),
                    pa.array(np.add.reduceat(weights, starts)),
                    pa.ListArray.from_arrays(np.arange(len(has) + 1, dtype=np.int32) * BANDS[0], pa.array(bands.ravel())),
                    pa.array([high[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    pa.array([light[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    pa.array([times[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                ],
                names=["member", "total", "bands", "grams", "weights", "counts"],
            )

    return work


def weighted_jaccard(g1: np.ndarray, w1: np.ndarray, g2: np.ndarray, w2: np.ndarray) -> float:
    """Sum of least weights by sum of greatest weights, of two sets sorted by hash."""
    if len(g1) > len(g2):
        g1, w1, g2, w2 = g2, w2, g1, w1
    if not len(g1):
        return 0.0
    at = np.minimum(np.searchsorted(g2, g1), len(g2) - 1)
    hit = g2[at] == g1
    both = np.minimum(w1[hit], w2[at[hit]]).sum(dtype=np.float64)
    return float(both / (w1.sum(dtype=np.float64) + w2.sum(dtype=np.float64) - both))


def _link_rows(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, *packed = (c.to_pylist() for c in batch.columns)
            keep = [
                weighted_jaccard(np.frombuffer(g1, "<u4"), np.frombuffer(w1, "<f4"), np.frombuffer(g2, "<u4"), np.frombuffer(w2, "<f4")) >= threshold - 1e-6
                for g1, w1, g2, w2 in zip(*packed)
            ]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])
        give_back()

    return work


def _links(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches the threshold."""
    left = members.select(F.col("member").alias("b"), F.col("grams").alias("g2"), F.col("weights").alias("w2"))
    right = members.select(F.col("member").alias("a"), F.col("grams").alias("g1"), F.col("weights").alias("w1"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "g1", "w1", "g2", "w2").mapInArrow(_link_rows(threshold), "a long, b long")


def _block_links(threshold: float):
    """Links among the members of one block, or between two, as few as hold together what is
    similar. All overlaps are found at once, as a product of matrices with a column for each shingle and repetition (the least of two counts is the
    number of repetitions that both have)."""

    def work(table: pa.Table) -> pa.Table:
        members, sides, totals = (np.asarray(table.column(c)) for c in ("member", "side", "total"))
        grams = [np.frombuffer(g, "<u4") for g in table.column("grams").to_pylist()]
        weights = [np.frombuffer(w, "<f4") for w in table.column("weights").to_pylist()]
        counts = [np.frombuffer(n, "<u4") for n in table.column("counts").to_pylist()]
        row = np.repeat(np.arange(len(grams)), [int(n.sum()) for n in counts])
        n = np.concatenate(counts).astype(np.int64)
        turn = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        column, at = np.unique(np.repeat(np.concatenate(grams).astype(np.uint64), n) | (turn.astype(np.uint64) << np.uint64(32)), return_inverse=True)
        idf = np.repeat(np.concatenate(weights) / n, n)
        shared = np.bincount(at) > 1  # what one member has alone adds to no overlap
        place = np.cumsum(shared) - 1
        keep = shared[at]
        overlap = np.zeros((len(grams), len(grams)))
        for lo in range(0, int(shared.sum()), COLUMNS):
            part = keep & (place[at] >= lo) & (place[at] < lo + COLUMNS)
            matrix = np.zeros((len(grams), COLUMNS), dtype=np.float32)
            matrix[row[part], place[at[part]] - lo] = np.sqrt(idf[part])
            overlap += matrix @ matrix.T
        similar = overlap >= (threshold - 1e-5) * (totals[:, None] + totals[None, :] - overlap)
        if (sides != sides[0]).any():
            similar &= sides[:, None] != sides[None, :]
        # of links that hang together, one for each member to one of them
        label, before = np.arange(len(grams)), None
        np.fill_diagonal(similar, True)
        while before is None or (label != before).any():
            before = label
            label = np.where(similar, label[None, :], len(label)).min(axis=1)
            label = label[label]
        own = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(members[own], pa.int64()), "b": pa.array(members[label[own]], pa.int64())})

    return work


def _leader_round(waiting: DataFrame, found: DataFrame, n_found: int, members: DataFrame, threshold: float, bands: int) -> tuple[DataFrame, DataFrame, int]:
    """Each bucket's leader against its members of other classes: (what still waits, the
    classes, their number of rows). A bucket whose members are of one class is finished."""
    named = waiting.join(maybe_broadcast(found, n_found), F.col("member") == F.col("node"), "left").select(
        "member", "total", "band", "bucket", F.coalesce("class", "member").alias("class")
    )
    mixed = stored(named.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("bucket"), "mixed")
    n_mixed = mixed.count()
    waiting = stored(named.join(maybe_broadcast(mixed, n_mixed), "bucket"), "waiting")
    now = waiting.filter(F.col("band") < bands)
    # one order of all members, so that buckets of the same members get the same leader
    first = F.min(F.struct(F.xxhash64("member").alias("chance"), "member", "total", "class"))
    leaders = stored(
        now.groupBy("bucket").agg(first.alias("l")).select("bucket", F.col("l.member").alias("a"), F.col("l.total").alias("a_total"), F.col("l.class").alias("a_class")),
        "leaders",
    )
    n_leaders = leaders.count()
    pairs = (
        now.join(maybe_broadcast(leaders, n_leaders), "bucket")
        .filter((F.col("class") != F.col("a_class")) & (F.least("total", "a_total") >= (threshold - 1e-6) * F.greatest("total", "a_total")))
        .select("a", F.col("member").alias("b"))
        .distinct()
    )
    new = stored(_links(pairs, members, threshold), "new-links")
    if not new.isEmpty():
        found = _joined(found, new)
        n_found = found.count()
    led = leaders.select("bucket", F.col("a").alias("member"))
    return waiting.drop("class").join(maybe_broadcast(led, n_leaders), ["bucket", "member"], "left_anti"), found, n_found


def _joined(found: DataFrame, new: DataFrame) -> DataFrame:
    """The classes after new links; what is known goes in as links to the class."""
    known = found.filter("node != class").select(F.col("node").alias("a"), F.col("class").alias("b"))
    return stored(components(known.union(new)), "classes")


def _classes(members: DataFrame, threshold: float) -> DataFrame:
    """(node, class) of the members that are linked."""
    buckets = members.select("member", "total", F.posexplode("bands").alias("band", "bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("member").alias("lo"), F.max("member").alias("hi")).filter("lo < hi").select("bucket")
    waiting = stored(buckets.join(shared, "bucket").distinct(), "buckets")
    found, n_found = members.sparkSession.createDataFrame([], "node long, class long"), 0
    for bands in (FIRST_BANDS, BANDS[0]):
        waiting, found, n_found = _leader_round(waiting, found, n_found, members, threshold, bands)

    # what still waits: members of buckets that are of more than one class
    named = waiting.join(maybe_broadcast(found, n_found), F.col("member") == F.col("node"), "left").select("member", "bucket", F.coalesce("class", "member").alias("class"))
    ends = named.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.min("member").alias("b")).filter("lo < hi")
    ends = stored(ends.select("bucket", "b"), "ends")
    left = stored(named.join(maybe_broadcast(ends, ends.count()), "bucket").select("member", "b").distinct(), "left")
    if left.isEmpty():
        return found
    # sets of members that hang together by such buckets, dealt out to blocks
    sets = stored(components(left.select(F.col("member").alias("a"), "b")), "sets")
    sizes = stored(sets.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks")), "sizes")
    dealt = sets.join(maybe_broadcast(sizes, sizes.count()), "class").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = dealt.select("class", F.col("node").alias("member"), "block", other.alias("other")).select(
        "class", "member", F.col("block").alias("side"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    packed = members.select("member", "total", "grams", "weights", "counts").distinct()
    new = placed.join(packed, "member").groupBy("class", "i", "j").applyInArrow(_block_links(threshold), "a long, b long")
    return _joined(found, stored(new, "block-links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id (long), ``class_id`` (the smallest id of its class) and
    ``kept`` (whether the id is that one).

    Two documents are linked if the weighted Jaccard similarity of their shingles is at least
    ``threshold``; classes are the connected components of the links. Words are runs of digits,
    letters a-z (A-Z lower-cased) and characters beyond ASCII. A text of one to four words has
    one shingle, all of it. A null, empty or wordless text is in a class of its own. A row
    with a null id is compared with nothing: its class is null and it is kept. Rows repeated
    with one id are one document, which has the links of all its texts. Other columns are not
    read. An empty table gives no rows.

    Scale: texts are read by a map four times and shuffled only for members that share a
    screening band (their ids are broadcast up to a counted bound). Keys and links are narrow
    rows; hot buckets and hot classes are aggregated with map-side combine or joined in joins
    that Spark can split. Sampling misses a pair at the threshold with a chance of about 0.002
    (less above it); apart from that no pair of a bucket is skipped.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_shingles(rows.select("text")))
    signed = stored(rows.mapInArrow(_signature_rows(heavy), "doc long, key1 long, key2 long, n int, bands array<long>"), "signatures")

    named = signed.filter("doc IS NOT NULL AND n > 0")
    groups = stored(named.groupBy("key1", "key2").agg(F.min("doc").alias("member"), F.min("bands").alias("bands")), "members")
    screen = groups.select("member", F.explode("bands").alias("bucket"))
    shared = screen.groupBy("bucket").agg(F.min("member").alias("lo"), F.max("member").alias("hi")).filter("lo < hi").select("bucket")
    ids = stored(screen.join(shared, "bucket", "left_semi").select(F.col("member").alias("doc")).distinct(), "screened")
    chosen = rows.join(maybe_broadcast(ids, ids.count()), "doc", "left_semi").distinct()
    members = stored(
        chosen.mapInArrow(_member_rows(heavy), "member long, total double, bands array<long>, grams binary, weights binary, counts binary"), "vectors"
    )
    linked = _classes(members, threshold)

    own = groups.join(linked, F.col("member") == F.col("node"), "left").select("key1", "key2", F.coalesce("class", "member").alias("class"))
    # an id with several texts has the class of each of them
    by_row = signed.join(stored(own, "own"), ["key1", "key2"], "left").select("doc", "n", "class")
    return by_row.select(
        F.col("doc").alias(id_col),
        F.when(F.col("doc").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc")).otherwise(F.col("class")).cast("long").alias("class_id"),
    ).withColumn("kept", F.coalesce(F.col("class_id") == F.col(id_col), F.lit(True)))
