"""Language identification: known words first, then shorter and shorter letter n-grams.

The model holds, for each language, the log frequency of words seen often enough and of the
1- to ``MAX_GRAM``-letter pieces of words (with marks for a word's ends). A known word adds its
log frequencies. An unseen word is read letter by letter, and at each place the longest known
piece that ends there adds its log frequencies. The language with the largest sum wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, text_or_empty

#: Rows that the model is learned from, at most (the smallest by a hash of their id), the
#: least count of a known word or piece, and the longest piece.
FIT_ROWS, MIN_COUNT, MAX_GRAM = 8_000, 3, 4
#: Characters worked on at once, words that a Python worker keeps.
SLICE_CHARS, MAX_WORDS = 2_000_000, 400_000

_RUNS = re.compile(r"[^\W\d_]+")


@dataclass
class LanguageModel:
    languages: list[str]
    words: dict[str, int] = field(default_factory=dict)  # row of word_logs
    word_logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    grams: dict[str, int] = field(default_factory=dict)
    gram_logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def of_word(self, word: str) -> np.ndarray:
        """The log frequencies that a lower-case word adds, one for each language; zeros if it
        has no letter."""
        at = self.words.get(word)
        if at is not None:
            return self.word_logs[at]
        if not word.isalpha():
            word = "".join(c for c in word if c.isalpha())
            if not word:
                return np.zeros(len(self.languages))
        marked, found = f"<{word}>", []
        for end in range(2, len(marked) + 1):
            for n in range(min(MAX_GRAM, end), 0, -1):
                row = self.grams.get(marked[end - n : end])
                if row is not None:
                    found.append(row)
                    break
        return self.gram_logs[found].sum(axis=0) if found else np.zeros(len(self.languages))


def _logs(counts: list[tuple[str, str, int]], languages: list[str], alpha: float) -> tuple[dict[str, int], np.ndarray]:
    rows = {key: i for i, key in enumerate(sorted({k for k, _, _ in counts}))}
    table = np.zeros((len(rows), len(languages)))
    at = {x: i for i, x in enumerate(languages)}
    for key, lang, n in counts:
        table[rows[key], at[lang]] = n
    return rows, np.log((table + alpha) / (table.sum(axis=0) + alpha * max(1, len(rows))))


def _often(counts: DataFrame, key: str, least: int) -> list[tuple[str, str, int]]:
    """(key, language, count) of keys counted ``least`` times in a language."""
    sums = counts.groupBy(key, "_lang").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return [(r[0], r[1], int(r[2])) for r in sums.collect()]


def _pieces(marked: Column, starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.substr(marked, i, F.lit(n)))


def fit_languages(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    fit_rows: int = FIT_ROWS,
    min_count: int = MIN_COUNT,
) -> LanguageModel:
    """Count words and pieces in the whole texts of a bounded sample: of the rows where
    ``learn`` holds and text and language are given, the ``fit_rows`` smallest by a hash of
    the id. What reaches the driver is the table of words and pieces counted ``min_count``
    times or more in that sample."""
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"), learn.alias("_learn"))
    known = named.filter("_learn AND _lang IS NOT NULL AND _text IS NOT NULL")
    # ids first, texts of the chosen ones after: the ordering carries no texts
    ids = known.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    sample = known.join(F.broadcast(ids.select(F.col("_id").alias("_chosen"))), F.col("_id").eqNullSafe(F.col("_chosen")), "left_semi")
    words = (
        sample.select("_lang", F.explode(F.split(F.lower("_text"), r"[^\p{L}]+")).alias("word"))
        .filter("word != ''")
        .groupBy("word", "_lang")
        .agg(F.count(F.lit(1)).alias("n"))
        .cache()
    )
    try:
        languages = sorted(r[0] for r in words.select("_lang").distinct().collect())
        marked, pieces = F.concat(F.lit("<"), "word", F.lit(">")), None
        for n in range(1, MAX_GRAM + 1):
            starts = F.sequence(F.lit(1), F.length(marked) - n + 1)
            part = words.filter(F.length(marked) >= n).select("_lang", "n", F.explode(_pieces(marked, starts, n)).alias("piece"))
            pieces = part if pieces is None else pieces.unionByName(part)
        word_counts, gram_counts = _often(words, "word", min_count), _often(pieces, "piece", min_count)
    finally:
        words.unpersist()
    w, wl = _logs(word_counts, languages, 0.1)
    g, gl = _logs(gram_counts, languages, 0.1)
    return LanguageModel(languages, w, wl, g, gl)


class _Scorer:
    """A model with the words a worker has met, in one growing table."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.languages)))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if len(self.rows) > MAX_WORDS:
            self.forget()
        rows, per_text = self.rows, []
        for text in texts:
            found = _RUNS.findall(text.lower())
            try:
                at = np.fromiter(map(rows.__getitem__, found), dtype=np.int64, count=len(found))
            except KeyError:
                for w in found:
                    if w not in rows:
                        k = rows[w] = len(rows)
                        if k >= len(self.table):
                            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                        self.table[k] = self.model.of_word(w)
                at = np.fromiter(map(rows.__getitem__, found), dtype=np.int64, count=len(found))
            has_letter = len(found) > 0 and any(c.isalpha() for w in found for c in w)
            per_text.append(self.table[at].sum(axis=0) if has_letter and self.model.languages else None)
        out = []
        for logs in per_text:
            if logs is None:
                out.append(("und", 0.0))
            else:
                best = int(logs.argmax())
                out.append((self.model.languages[best], float(1.0 / np.exp(logs - logs[best]).sum())))
        return out


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``lang_pred`` and ``score`` (the share of the predicted
    language in the likelihood, 0 to 1).

    A null text, or one without a letter, gives ``und`` and 0; so does a model without
    languages. Equal sums go to the language that sorts first. Ids are passed through, null
    or repeated; other columns are not read. An empty table gives no rows. No shuffle; the
    model (bounded by its sample) goes to each executor once.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(np.asarray(pc.binary_length(texts)).tolist(), SLICE_CHARS):
                found = scorer.predict(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=[id_col, "lang_pred", "score"],
                )

    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("_text"))
    return rows.mapInArrow(work, f"`{id_col}` {id_type}, lang_pred string, score double")
