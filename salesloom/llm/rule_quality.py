"""Quality classifier: a sparse ensemble of rules.

Statistics of each text (shares of character kinds, word lengths, repetition, lines) feed a
random forest; each path from a root to a node is a conjunctive rule over statistics. A
logistic regression with lasso penalty over the rules as 0/1 features keeps a few of them,
and these are compiled into one Spark column expression over the statistics columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from .common import give_back, slices, stored, text_batches, text_or_empty

#: Rows that the classifier is fitted on, at most: the labelled rows smallest by a hash of
#: their id. Everything else (scores) covers all rows.
FIT_ROWS = 20_000
#: Bytes of text that a task has as Python strings at once.
SLICE_BYTES = 1_000_000

#: The column of statistics.
STATS = "_rule_statistics"

#: The statistics of a text; shares are of its characters unless said otherwise.
#: ``distinct_words`` compares logarithms (of distinct words and of words), as the plain
#: share falls with a text's length.
STATISTICS = [
    "log_chars", "upper", "lower", "digit", "space", "newline", "symbol", "bang", "pipe", "stop_mark",
    "word_length", "distinct_words", "top_word", "longest_word", "symbol_words", "upper_words", "line_length", "distinct_lines",
]

_KINDS = 9  # of characters: the eight below and the rest


def _kind_table() -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)  # bytes; those above 127 are letters of some kind
    table[128:] = 2
    for c in range(128):
        ch = chr(c)
        table[c] = (
            1 if ch.isupper() else 2 if ch.islower() else 3 if ch.isdigit() else 5 if ch == "\n" else 4 if ch.isspace()
            else 7 if ch == "!" else 8 if ch == "|" else 0 if ch in ".,;:?'\"-()" else 6
        )
    return table


_TABLE = _kind_table()


def text_statistics(text: str) -> list[float]:
    """The statistics of one whole text; all 0 for an empty one."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    marks, upper, lower, digit, space, newline, symbol, bang, pipe = (np.bincount(_TABLE[raw], minlength=_KINDS) / n).tolist()
    words = text.split()
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    n_words = max(1, len(words))
    plain = sum(k for w, k in counts.items() if w.isalpha())
    shouted = sum(k for w, k in counts.items() if w.isupper())
    odd = sum(k for w, k in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:?'\"-()")
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        math.log1p(n), upper, lower, digit, space, newline, symbol, bang, pipe, marks,
        plain and sum(len(w) * k for w, k in counts.items()) / n_words, math.log1p(len(counts)) / math.log1p(n_words), max(counts.values(), default=0) / n_words,
        math.log1p(max(map(len, counts), default=0)), odd / n_words, shouted / n_words, math.log1p(len(words) / max(1, len(lines))),
        len(set(lines)) / max(1, len(lines)),
    ]


def with_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` and a column ``STATS`` (array of double)."""
    keep = keep or []

    @F.arrow_udf("array<double>")
    def stats(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            rows = []
            for a, b in slices(np.asarray(pc.binary_length(part)).tolist(), SLICE_BYTES):
                rows += [text_statistics(t) for t in part.slice(a, b - a).to_pylist()]
            yield pa.array(rows, pa.list_(pa.float64()))
        give_back()

    text_batches(docs.sparkSession)
    return docs.select(*keep, stats(text_or_empty(text_col)).alias(STATS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above the bound, bound) with a weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def column(self, stats: Column) -> Column:
        test = F.lit(True)
        for i, above, bound in self.terms:
            test &= (stats[i] > bound) if above else (stats[i] <= bound)
        return test


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, stats: Column) -> Column:
        """Probability of label 1 as a column expression over the statistics."""
        total = F.lit(float(self.intercept))
        for r in self.rules:
            total += F.when(r.column(stats), F.lit(float(r.weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def describe(self) -> list[str]:
        return [
            f"{r.weight:+.3f}: " + " and ".join(f"{STATISTICS[i]} {'>' if above else '<='} {bound:.4g}" for i, above, bound in r.terms) for r in self.rules
        ]


def _paths(node, terms: tuple = ()) -> Iterator[tuple]:
    """The conjunctions from a tree's root to each node below it."""
    if terms:
        yield terms
    if node.numDescendants() > 0 if hasattr(node, "numDescendants") else node.subtreeDepth() > 0:
        split = node.split()
        i, bound = split.featureIndex(), float(split.threshold())
        yield from _paths(node.leftChild(), (*terms, (i, False, bound)))
        yield from _paths(node.rightChild(), (*terms, (i, True, bound)))


def _simplified(terms: tuple) -> tuple:
    """One bound for each statistic and direction, in a fixed order."""
    tight: dict[tuple[int, bool], float] = {}
    for i, above, bound in terms:
        old = tight.get((i, above))
        tight[i, above] = bound if old is None else max(old, bound) if above else min(old, bound)
    return tuple((i, above, b) for (i, above), b in sorted(tight.items()))


def fit_rules(
    rows: DataFrame,
    stats_col: str = STATS,
    label_col: str = "label",
    trees: int = 20,
    depth: int = 3,
    lasso: float = 0.002,
    seed: int = 7,
) -> RuleModel:
    """Fit on all of ``rows`` (bounded by the caller). Without rows, or with one label only,
    the model has no rules and gives the share of label 1, pulled to one half by one row of
    each label."""
    data = stored(rows.select(array_to_vector(F.col(stats_col)).alias("features"), F.col(stats_col).alias("stats"), F.col(label_col).cast("double").alias("label")), "fit-rows")
    n, ones = data.agg(F.count(F.lit(1)), F.coalesce(F.sum("label").cast("long"), F.lit(0))).first()
    prior = (ones + 1) / (n + 2)
    base = RuleModel(math.log(prior / (1 - prior)), ())
    if ones in (0, n):
        return base
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, seed=seed, featureSubsetStrategy="0.4", subsamplingRate=0.7).fit(data)
    found = sorted({_simplified(t) for tree in forest.trees for t in _paths(tree._call_java("rootNode"))})
    if not found:
        return base
    fired = F.array(*(Rule(t).column(F.col("stats")).cast("double") for t in found))
    hits = stored(data.select(array_to_vector(fired).alias("features"), "label"), "fit-rules")
    fit = LogisticRegression(elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=100).fit(hits)
    weights = fit.coefficients.toArray()
    return RuleModel(float(fit.intercept), tuple(Rule(t, float(w)) for t, w in zip(found, weights) if abs(w) > 1e-6))


def fit_from_labels(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    fit_rows: int = FIT_ROWS,
) -> RuleModel:
    """Fit on the labelled rows where ``learn`` (over the id) holds: the ``fit_rows`` smallest
    by a hash of the id, so the sample is bounded, spread over the table and repeatable. The
    bound is on rows: equal rows count once, and an id with many texts does not widen it.
    Labels without id or label are left out; of labels that disagree on an id the larger
    counts. Only sampled ids and text hashes (at most ``fit_rows``) are sent to the executors."""
    sample = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
        .dropna()
        .groupBy("_id")
        .agg(F.max("label").alias("label"))
        .withColumnRenamed("_id", id_col)
        .filter(learn)
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(fit_rows)
        .withColumnRenamed(id_col, "_id")
    )
    text_hash = F.xxhash64(text_or_empty(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), text_hash.alias("_hash")).join(F.broadcast(sample), "_id")
    rows = rows.dropDuplicates(["_id", "_hash"]).orderBy(F.xxhash64("_id"), "_id", "_hash").limit(fit_rows)
    rows = stored(rows, "fit-sample")
    chosen = docs.select(F.col(id_col).alias("_id"), text_hash.alias("_hash"), F.col(text_col)).join(F.broadcast(rows), ["_id", "_hash"])
    chosen = chosen.groupBy("_id", "_hash", "label").agg(F.first(text_col).alias(text_col))
    return fit_rules(with_statistics(chosen, text_col, ["label", "_id", "_hash"]).orderBy("_id", "_hash"))


def rule_quality(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Null text counts as empty; an empty text has all statistics 0 and is scored like any
    other. Ids are passed through, null or repeated. Other columns are not read. An empty
    table gives no rows. No shuffle: a map over the texts.
    """
    return (
        with_statistics(docs, text_col, [id_col])
        .withColumn("score", model.score(F.col(STATS)))
        .select(id_col, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )
