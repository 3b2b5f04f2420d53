"""Token ids in files: one zstandard frame a document, a shared dictionary, an offset index.

A store is a folder in the shared file system:

``dictionary-<sha256>.zdict``
    The dictionary, trained on serialized id arrays of a bounded sample of documents.
``shard-<part>-<uuid>.bin``
    Frames end to end, documents in ascending order of id; part follows part.
``shard-<part>-<uuid>.idx``
    Arrow IPC file with a row per document: ``id``, ``offset`` and ``size`` of its frame,
    ``first`` (ids of the shard before it) and ``n_tokens``. Its schema's metadata names the
    dictionary by its hash and gives the width of an id in bytes.
``manifest`` table (returned by ``write_store``)
    A row per shard. Only shards of tasks that came through are in it, so files that a lost
    executor left behind are not part of the store.

One document is read by its index row and the bytes of its frame alone (``read_document``).
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from .bpe import byte_letters
from .common import shared_dir, slices, stored, text_or_empty

#: The sample that trains the dictionary: documents (the first by a hash of their ids), the
#: longest one that is used, and the sum, all as serialized bytes; and the dictionary's size.
SAMPLE_DOCS, SAMPLE_DOC_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 2_000, 64 << 10, 8 << 20, 64 << 10
#: zstandard's level; characters worked on at once; bytes of frames read at once.
LEVEL, SLICE_CHARS, READ_BYTES = 3, 8_000_000, 8 << 20
#: Words a Python worker remembers, and the longest one.
MAX_KNOWN, MAX_KNOWN_CHARS = 400_000, 64
#: Most tasks that read a store.
READ_TASKS = 20_000

_MANIFEST = "part long, file string, docs long, tokens long, bytes long, batches int"


# --- ids of texts ---------------------------------------------------------------------------


#: Fixed value: the normalizers of the tokenizer files that are taken.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Pieces whose normalized form is their lower case: visible ASCII and Latin-1.
_PLAIN = r"^[\x21-\x7e\x{a1}-\x{ff}]+$"


def _gather(which: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items ``which`` of the items that lie end to end in ``flat``: the result and its sizes."""
    starts, long = np.cumsum(sizes) - sizes, sizes[which]
    return flat[np.arange(long.sum()) + np.repeat(starts[which] - (np.cumsum(long) - long), long)], long


class PieceEncoder:
    """Ids of texts by the tokenizers library, of each distinct word once.

    For tokenizer files that drop white space and see no token across it: texts are cut at ASCII
    white space; a distinct piece of plain letters is cut into words by the file's own pattern,
    and new words go to the library's model; any other piece goes through all of the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if (spec.get("normalizer") or {}).get("normalizers") != NORMALIZERS or [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"]:
            raise ValueError("a lower-casing BPE that drops white space is needed")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.largest = max(self.library.get_vocab(with_added_tokens=True).values(), default=0)
        self._model, self._pattern = self.library.model, steps[0]["pattern"]["Regex"]
        self._letters = {b: c for c, b in byte_letters().items()}  # by byte, as str.translate takes it
        self._special = [t["content"] for t in spec.get("added_tokens", [])]
        self.words: dict[str, bytes] = {}

    def _word(self, word: str, kind: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self._letters)
        ids = [t.id for t in self._model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}{'H' if kind == '<u2' else 'I'}", *ids)

    def _words(self, words: list[str], kind: str) -> list[bytes]:
        """The ids of distinct words; the known ones are kept up to a bound, then those in use."""
        known = self.words
        found = [ids if (ids := known.get(w)) is not None else self._word(w, kind) if w else b"" for w in words]
        known.update((w, ids) for w, ids in zip(words, found) if len(w) <= MAX_KNOWN_CHARS)
        if len(known) > MAX_KNOWN:
            self.words = dict(list(known.items())[-MAX_KNOWN // 2 :])
        return found

    def _pieces(self, pieces: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces end to end, and their numbers."""
        plain = pc.match_substring_regex(pieces, _PLAIN)
        for s in self._special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(pieces, s)))
        spaced = pc.replace_substring_regex(pc.utf8_lower(pieces.filter(plain)), self._pattern, r"\0 ")
        split = pc.ascii_split_whitespace(spaced)
        coded = split.flatten().dictionary_encode()
        words = self._words(coded.dictionary.to_pylist(), kind)
        width = np.dtype(kind).itemsize
        flat, sizes = _gather(np.asarray(coded.indices), np.fromiter(map(len, words), np.int64, len(words)) // width, np.frombuffer(b"".join(words), kind))
        rows = np.asarray(split.offsets)
        total = np.concatenate([[0], np.cumsum(sizes)])[rows]
        others = [np.array(self.library.encode(p, add_special_tokens=False).ids if p else [], kind) for p in pieces.filter(pc.invert(plain)).to_pylist()]
        where = np.asarray(plain)
        order = np.concatenate([np.flatnonzero(where), np.flatnonzero(~where)])
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return _gather(back, np.concatenate([np.diff(total), np.array([len(o) for o in others], np.int64)]), np.concatenate([flat, *others]))

    def encode(self, texts: pa.Array, end_id: int, width: int) -> pa.Array:
        """Ids of each text (no nulls) and the end id, serialized little-endian."""
        kind = f"<u{width}"
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        flat, sizes = self._pieces(coded.dictionary, kind)
        # the end id is one more piece at the end of each row
        rows = np.asarray(split.offsets)
        rows = rows - rows[0]
        which = np.insert(np.asarray(coded.indices, np.int64), rows[1:], len(sizes))
        ids, sizes = _gather(which, np.append(sizes, 1), np.append(flat, np.array([end_id], kind)))
        bounds = np.concatenate([[0], np.cumsum(sizes)])[rows + np.arange(len(texts) + 1)] * width
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds), pa.py_buffer(ids)]).cast(pa.binary())


@lru_cache(maxsize=1)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def id_width(path: str, end_id: int) -> int:
    """Bytes of a stored id: 2 if all ids fit, else 4."""
    return 2 if max(_encoder(path).largest, end_id) < 1 << 16 else 4


def encode(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the serialized ids of each row's whole text, with the end id; null is empty."""
    width = id_width(tokenizer, end_id)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(np.asarray(pc.binary_length(texts)).tolist(), SLICE_CHARS):
                packed = encoder.encode(texts.slice(a, b - a), end_id, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), packed], names=["id", "ids"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(work, f"id {id_type}, ids binary")


# --- the dictionary -------------------------------------------------------------------------


def train_dictionary(encoded: DataFrame) -> bytes:
    """A dictionary for ``encoded`` (id, ids, _hash, _tie), from a sample bounded as above;
    empty if there are too few documents to train one. It changes the files, never the ids."""
    size = F.octet_length("ids")
    first = encoded.filter(size <= SAMPLE_DOC_BYTES).select("_hash", "_tie", size.alias("size")).orderBy("_hash", "_tie").limit(SAMPLE_DOCS).collect()
    total, ties = 0, []
    for row in first:
        total += row["size"]
        if total > SAMPLE_BYTES:
            break
        ties.append(row["_tie"])
    samples = [bytes(r["ids"]) for r in encoded.filter(F.col("_tie").isin(ties)).select("ids").collect()] if ties else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(samples)).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dict_data(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


@lru_cache(maxsize=4)
def _dictionary(folder: str, digest: str) -> bytes:
    """The dictionary that an index names; its bytes must have that hash."""
    files, path = _files(f"{folder}/dictionary-{digest}.zdict")
    with files.open_input_file(path) as f:
        found = f.read()
    if sha256(found).hexdigest() != digest:
        raise ValueError(f"the dictionary of {folder} is not the one that its index names")
    return found


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


# --- writing --------------------------------------------------------------------------------


def _index_schema(id_type: pa.DataType, digest: str, width: int, end_id: int) -> pa.Schema:
    fields = [("id", id_type), ("offset", pa.int64()), ("size", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())]
    return pa.schema(fields, metadata={"dictionary_sha256": digest, "id_bytes": str(width), "end_id": str(end_id)})


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode every row's whole text, append ``end_id``, and write a store in ascending order
    of id. Gives its folder and its manifest (part, file, docs, tokens, bytes, batches).

    Null text counts as empty and is one end id. Null ids come first; rows with one id are
    ordered by a hash of their ids; equal rows are all written. An empty table makes a store
    without shards. Other columns are not read. ``folder`` is a URI that all executors reach,
    by default a new one under ``spark.checkpoint.dir``.

    Scale: texts are read once; ids (two or four bytes) are stored, then sorted by ranges in
    one shuffle, where an id that many rows share is split by hash and row. A task holds one
    Arrow batch and streams frames and index to its shard.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    width = id_width(tokenizer, end_id)
    encoded = encode(docs, tokenizer, end_id, id_col, text_col)
    encoded = stored(encoded.withColumns({"_hash": F.xxhash64("ids"), "_tie": F.monotonically_increasing_id()}), "ids")
    dictionary = train_dictionary(encoded)
    digest = sha256(dictionary).hexdigest()
    files, path = _files(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/dictionary-{digest}.zdict") as f:
        f.write(dictionary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict_data(_dictionary(folder, digest))).compress
        part = TaskContext.get().partitionId()
        name = f"shard-{part:06d}-{uuid.uuid4().hex}"
        docs = tokens = offset = n_batches = 0
        data = index = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if data is None:
                schema = _index_schema(batch.schema.field("id").type, digest, width, end_id)
                data = files.open_output_stream(f"{path}/{name}.bin")
                sink = files.open_output_stream(f"{path}/{name}.idx")
                index = pa.ipc.new_file(sink, schema)
            counts = np.asarray(pc.binary_length(batch["ids"])).astype(np.int64) // width
            sizes = np.zeros(batch.num_rows, np.int64)
            for i, ids in enumerate(batch["ids"]):
                frame = pack(ids.as_buffer())
                sizes[i] = len(frame)
                data.write(frame)
            offsets, firsts = offset + np.cumsum(sizes) - sizes, tokens + np.cumsum(counts) - counts
            index.write_batch(pa.RecordBatch.from_arrays([batch["id"], *map(pa.array, (offsets, sizes, firsts, counts))], schema=schema))
            docs, offset, tokens, n_batches = docs + batch.num_rows, offset + int(sizes.sum()), tokens + int(counts.sum()), n_batches + 1
        if data is not None:
            for f in (data, index, sink):
                f.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "docs": docs, "tokens": tokens, "bytes": offset, "batches": n_batches}], schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()), ("batches", pa.int32())]))

    by = [F.col("id").asc_nulls_first(), F.col("_hash"), F.col("_tie")]
    ordered = encoded.repartitionByRange(*by).sortWithinPartitions(*by).select("id", "ids")
    return folder, stored(ordered.mapInArrow(work, _MANIFEST), "manifest")


# --- reading --------------------------------------------------------------------------------


class Shard:
    """A shard's index and frames."""

    def __init__(self, folder: str, name: str):
        files, path = _files(folder)
        self._data, self._sink = files.open_input_file(f"{path}/{name}.bin"), files.open_input_file(f"{path}/{name}.idx")
        self.index = pa.ipc.open_file(self._sink)
        meta = self.index.schema.metadata
        self.type = np.dtype(f"<u{int(meta[b'id_bytes'])}")
        dictionary = _dictionary(folder, meta[b"dictionary_sha256"].decode())
        self._unpack = zstandard.ZstdDecompressor(dict_data=_dict_data(dictionary)).decompress

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self._data.close()
        self._sink.close()

    def frames(self, rows: pa.RecordBatch) -> Iterator[np.ndarray]:
        """The ids of consecutive documents, read in pieces of bounded size."""
        sizes, begin = rows["size"].to_pylist(), rows["offset"][0].as_py()
        for a, b in slices(sizes, READ_BYTES):
            self._data.seek(begin)
            piece, at = memoryview(self._data.read(sum(sizes[a:b]))), 0
            for size in sizes[a:b]:
                yield np.frombuffer(self._unpack(piece[at : at + size]), self.type)
                at += size
            begin += at

    def document(self, row: int) -> np.ndarray:
        """The ids of one document, by its place in the shard."""
        for i in range(self.index.num_record_batches):
            batch = self.index.get_batch(i)
            if row < batch.num_rows:
                return next(self.frames(batch.slice(row, 1)))
            row -= batch.num_rows
        raise IndexError("the shard has fewer documents")


def read_document(folder: str, file: str, row: int) -> np.ndarray:
    """Ids of the document at place ``row`` of a shard: one index lookup, one frame."""
    with Shard(folder, file) as shard:
        return shard.document(row)


def read_store(spark: SparkSession, folder: str, manifest: DataFrame, id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """One row per document of a store: id, ``start`` (ids of all documents before it),
    ``n_tokens``, and ``ids`` (binary, little-endian unsigned 32-bit) or, with ``digest``,
    ``ids_crc32`` of those bytes.

    A frame that does not hold the number of ids its index says fails the read. An empty
    manifest gives no rows.

    Scale: a task reads index batches (up to 10,000 documents each) and their frames in pieces
    of ``READ_BYTES``; only the manifest's rows, one a shard, pass through a window.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("_start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    units = stored(shards.select("file", "_start", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("batch")), "units")
    id_type = manifest_id_type(folder, manifest)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in (u for b in batches for u in b.to_pylist()):
            with Shard(folder, unit["file"]) as shard:
                rows = shard.index.get_batch(unit["batch"])
                found = (ids.astype("<u4") for ids in shard.frames(rows))
                for a, b in slices([4 * n for n in rows["n_tokens"].to_pylist()], READ_BYTES):
                    packed = [next(found).tobytes() for _ in range(a, b)]
                    counts = np.array([len(p) // 4 for p in packed], np.int64)
                    if not np.array_equal(counts, np.asarray(rows["n_tokens"])[a:b]):
                        raise ValueError(f"{unit['file']}: a frame does not hold what its index says")
                    starts = pa.array(unit["_start"] + np.asarray(rows["first"])[a:b])
                    last = pa.array([zlib.crc32(p) for p in packed], pa.int64()) if digest else pa.array(packed, pa.binary())
                    yield pa.RecordBatch.from_arrays([rows["id"].slice(a, b - a), starts, pa.array(counts), last], names=[id_col, "start", "n_tokens", "ids_crc32" if digest else "ids"])

    n = units.count()
    schema = f"`{id_col}` {id_type}, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary")
    return units.repartition(max(1, min(n, READ_TASKS))).mapInArrow(work, schema)


def manifest_id_type(folder: str, manifest: DataFrame) -> str:
    """Spark's name of the type of ids, from the index of one shard."""
    from pyspark.sql.pandas.types import from_arrow_type

    first = manifest.select("file").first()
    if first is None:
        return "long"
    with Shard(folder, first["file"]) as shard:
        return from_arrow_type(shard.index.schema.field("id").type).simpleString()
