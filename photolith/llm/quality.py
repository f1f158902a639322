"""Quality rules: an isolation forest over rule statistics, with a threshold calibrated from labelled rows.

One pass over the texts gives each document's statistics, a few numbers a row, which go to the shared folder; the rest
reads only those. The forest is fitted on a bounded sample (``FIT_ROWS`` rows in the order of a hash of the id, of
which each tree takes ``TREE_ROWS``): random splits on random statistics, so that an anomalous document is alone after
few. Its score is 2^(-mean path length / that of an average search). All labelled rows are then counted by score bin and
label, and the threshold is where the share of bad rows found less the share of good rows lost is highest, among
those that lose at most ``LOSS`` of the good ones.

Nulls: a null text has no words and fails the base rules; a label counts if its quality is 0 or 1. Without labels of
both kinds nothing is anomalous. Rows that share an id share its labels, and each stands for itself. Empty tables give
no rows. Columns besides doc_id and text are ignored, whatever their names. Texts are taken whole, of any length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith.llm.common import materialize, table

FIT_ROWS = 8192
TREES = 100
TREE_ROWS = 256
BINS = 1000
LOSS = 0.01
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
_SYMBOL = re.compile(b"[#*$%&|<>]")
_SPACE = " \t\n\r\x0b\x0c"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the forest sees: symbols per character, shares of words with a symbol and of words of at most three characters,
#: exclamation and question marks per word. Repetition and length are the base rules' matter.
RATIOS = ["r_symbols", "r_symbol_words", "r_short_words", "r_marks"]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that are found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    if len(seen) == len(words):
        return 0
    mixed = (ids + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    hashed = np.zeros(n, np.uint64)
    for k in range(window):
        hashed = hashed * np.uint64(0x100000001B3) + mixed[k : k + n]
    _, first, counts = np.unique(hashed, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[first] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def statistics(text: str) -> tuple:
    """The base counts and the ratios that the forest sees."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    spaces = sum(map(text.count, _SPACE))
    chars = len(text) - spaces
    symbols = sum(map(text.count, SYMBOLS))
    lines = Counter(line for line in text.split("\n") if line.strip(_SPACE))
    total_lines = sum(lines.values())
    dup_lines = total_lines - len(lines)
    repeat = repeated_words(words)
    with_symbol = sum(map(bool, map(_SYMBOL.search, words))) if symbols else 0
    short = sum(len(w) <= 3 for w in map(bytes.decode, words))
    marks = sum(map(text.count, "!?"))
    ratios = (symbols / chars, with_symbol / n, short / n, marks / n) if n else (0.0,) * 4
    return (n, chars, symbols, dup_lines, repeat, *ratios)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, base counts, ratios)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*[statistics(t or "") for t in batch.column(1).to_pylist()], strict=True))
            if found:
                kinds = [pa.int64()] * len(BASE) + [pa.float64()] * len(RATIOS)
                columns = [pa.array(c, k) for c, k in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *BASE, *RATIOS])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in BASE), *(f"{c} double" for c in RATIOS)])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows: what a leaf with n rows still lacks."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as flat arrays: feature (-1 in a leaf), threshold, left child (right is next), depth with what a leaf lacks."""

    def __init__(self, rows: np.ndarray, seed: int = 7, trees: int = TREES, tree_rows: int = TREE_ROWS) -> None:
        random = np.random.default_rng(seed)
        self.size = min(tree_rows, len(rows))
        self.trees = [self._grow(rows[random.permutation(len(rows))[: self.size]], random) for _ in range(trees)] if len(rows) else []

    def _grow(self, rows: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, threshold, left, depth = [], [], [], []
        deepest = int(np.ceil(np.log2(max(len(rows), 2)))) + 2
        waiting = [(0, rows, 0)]
        feature.append(-1), threshold.append(0.0), left.append(0), depth.append(0.0)
        while waiting:
            node, part, level = waiting.pop()
            spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 else []
            if len(spread) == 0 or level >= deepest:
                depth[node] = level + float(average_path(len(part)))
                continue
            f = int(random.choice(spread))
            low, high = part[:, f].min(), part[:, f].max()
            at = random.uniform(low, high)
            below = part[:, f] <= at
            feature[node], threshold[node], left[node] = f, at, len(feature)
            for half in (part[below], part[~below]):
                waiting.append((len(feature), half, level + 1))
                feature.append(-1), threshold.append(0.0), left.append(0), depth.append(0.0)
        return np.array(feature), np.array(threshold), np.array(left), np.array(depth)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; near 1: isolated after few splits."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, threshold, left, depth in self.trees:
            node = np.zeros(len(rows), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                step = left[node] + (rows[every, np.maximum(f, 0)] > threshold[node])
                node = np.where(inner, step, node)
            total += depth[node]
        return np.exp2(-total / len(self.trees) / max(float(average_path(self.size)), 1e-9))


def best_threshold(counts: list[tuple[int, int, int]], loss: float = LOSS, bins: int = BINS) -> float:
    """From (bin, label, rows): the score from which on a document is anomalous. Above 1 if labels of a kind are missing."""
    by = np.zeros((bins + 1, 2))
    for at, label, n in counts:
        by[at, label] += n
    bad, good = by[::-1].cumsum(0)[::-1].T  # rows at or above each bin
    if not bad[0] or not good[0]:
        return 2.0
    gain = np.where(good / good[0] <= loss, bad / bad[0] - good / good[0], -1.0)
    at = int(gain.argmax())
    return at / bins if gain[at] > 0 else 2.0


def fit_forest(stats: DataFrame, rows: int = FIT_ROWS) -> IsolationForest:
    """Fitted on at most ``rows`` rows, the first in the order of a hash."""
    sample = stats.where("not base_failed").orderBy(F.xxhash64("doc_id", *RATIOS), *RATIOS).limit(rows).select(*RATIOS).toArrow()
    return IsolationForest(np.column_stack([c.to_numpy() for c in sample.columns]) if sample.num_rows else np.zeros((0, len(RATIOS))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def calibrate(stats: DataFrame, labels: DataFrame) -> tuple[IsolationForest, float]:
    """The forest and the score from which on a document is anomalous."""
    forest = fit_forest(stats)
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = (
        stats.where("not base_failed").withColumn("anomaly", anomaly(forest)(*RATIOS)).join(known, "doc_id")
        .groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"), "quality").count().collect()
    )
    return forest, best_threshold([tuple(r) for r in counts])


def anomaly(forest: IsolationForest):
    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.column_stack([c.to_numpy(float) for c in columns])))

    return score


def passes(score: Column, threshold: float) -> Column:
    return F.floor(score * BINS) < round(threshold * BINS)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text), (doc_id, quality) -> base counts, base_failed, anomaly, kept per document."""
    stats = materialize(document_statistics(docs).withColumn("base_failed", base_failed()), "quality-statistics")
    forest, threshold = calibrate(stats, labels)
    scored = stats.withColumn("anomaly", anomaly(forest)(*RATIOS))
    return scored.withColumn("kept", ~F.col("base_failed") & passes(F.col("anomaly"), threshold))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, judged where they are: no text is shuffled."""
    stats = materialize(document_statistics(docs).withColumn("base_failed", base_failed()), "quality-statistics")
    forest, threshold = calibrate(stats, labels)

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        rows = [statistics(t or "") for t in texts]
        ratios = np.array([r[len(BASE) :] for r in rows], float).reshape(-1, len(RATIOS))
        failed = np.array([r[0] < MIN_WORDS or 100 * r[4] > MAX_REPEAT_PERCENT * r[0] for r in rows], bool)
        return pd.Series(~failed & (np.floor(forest.score(ratios) * BINS) < round(threshold * BINS)))

    return docs.where(keep("text"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *BASE, "base_failed", "kept", "anomaly")
