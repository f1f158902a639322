"""Toxicity: a factorization machine over hashed terms, which also learns what pairs of terms mean together.

Terms are the lower-cased words of a text and the first four and five letters of longer words, hashed to 2^20 buckets;
a text's features are the buckets it has. The machine scores bias + weights + the products of the factors of every two
features present, so that two terms that are harmless alone can count together, through a logistic function.

Fitting reads a bounded sample of labelled rows: the first ``FIT_TOXIC`` rows with label 1 and the first ``FIT_CLEAN``
with label 0 in the order of a hash of the id, weighed as the labels are distributed; rows held out are left out before.
Buckets enter if their distribution over the labels is far from chance (chi-square), so that a long
text doesn't gather the noise of thousands of neutral words. Scoring is one pass over the texts and no shuffle.

Nulls: a null text counts as empty and gets the bias's score; a label counts if it is 0 or 1, and the highest of an id
with several. Without labels of both kinds every score is the share of label 1 (0.0 if there are none). Rows that share
an id are scored each. Empty tables give no rows. Other columns are never read, whatever
their names. Texts are taken whole, of any length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith.llm.common import give_back, held_out, table

BUCKETS = 1 << 20
FIT_TOXIC = 4096
FIT_CLEAN = 8192
CHI_SQUARE = 15.0
FACTORS = 8
STEPS = 300
FOLD, HELD_OUT = 5, 0
#: A task holds so many words' features at most.
HELD = 50_000
_LETTERS = re.compile(r"[^\W\d_]+")


def buckets_of(word: str) -> list[int]:
    raw = word.encode()
    found = [zlib.crc32(raw) % BUCKETS]
    if len(word) > 5:
        found += [zlib.crc32(b"^" + word[:k].encode()) % BUCKETS for k in (4, 5)]
    return found


def words_of(text: str) -> set[str]:
    return set(_LETTERS.findall(text.lower()))


def terms(text: str) -> np.ndarray:
    """The distinct buckets of a text's terms."""
    return np.array(sorted({b for w in words_of(text) for b in buckets_of(w)}), np.int32)


class _Features(dict):
    """word -> its places among the model's buckets; of bounded size, and gone with the task."""

    def __init__(self, place: dict[int, int]) -> None:
        self._place = place

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > HELD:
            self.clear()
        self[word] = made = tuple(self._place[b] for b in buckets_of(word) if b in self._place)
        return made


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return row, (np.concatenate(rows) if len(row) else np.zeros(0, np.int32)).astype(np.int64)


class FactorizationMachine:
    """Chosen buckets with their weights and factors."""

    def __init__(self, buckets: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray) -> None:
        self.place = {int(b): k for k, b in enumerate(buckets)}
        self.bias, self.weights, self.factors = bias, weights, factors

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray, row_weights: np.ndarray, seed: int = 11) -> FactorizationMachine:
        total = row_weights.sum()
        share = float((row_weights * labels).sum() / total) if total else 0.0
        if not 0 < share < 1:
            return cls(np.zeros(0, np.int32), -1e3 if share == 0 else 1e3, np.zeros(0), np.zeros((0, FACTORS)))
        buckets = cls._chosen(rows, labels)
        place = np.full(BUCKETS, -1)
        place[buckets] = np.arange(len(buckets))
        row, bucket = _flat(rows)
        feature = place[bucket]
        row, feature = row[feature >= 0], feature[feature >= 0]
        random = np.random.default_rng(seed)
        bias, w = np.array([np.log(share / (1 - share))]), np.zeros(len(buckets))
        v = random.normal(0, 0.05, (len(buckets), FACTORS))
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (bias, w, v)]
        scale = row_weights / total
        for step in range(1, STEPS + 1):
            sums = _row_sums(row, v[feature], len(rows))
            score = bias[0] + _row_sums(row, w[feature, None], len(rows))[:, 0] + _pairs(row, v, feature, sums)
            error = (_logistic(score) - labels) * scale
            e = error[row]
            grad_v = np.stack([np.bincount(feature, e * (sums[row, k] - v[feature, k]), len(buckets)) for k in range(FACTORS)], 1)
            grads = (np.array([error.sum()]), np.bincount(feature, e, len(buckets)) + 1e-5 * w, grad_v + 1e-4 * v)
            for p, g, (m1, m2) in zip((bias, w, v), grads, state, strict=True):  # Adam
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                p -= 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-10)
        return cls(buckets, float(bias[0]), w, v)

    @staticmethod
    def _chosen(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
        """Buckets whose presence and label go together more than chance has it."""
        row, bucket = _flat(rows)
        n, n1 = len(rows), labels.sum()
        a = np.bincount(bucket, labels[row], BUCKETS)
        df = np.bincount(bucket, minlength=BUCKETS).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = n * (a * n - df * n1) ** 2 / (df * n1 * (n - df) * (n - n1))
        chi[(df < 3) | ~np.isfinite(chi)] = 0
        return np.flatnonzero(chi > CHI_SQUARE)

    def features(self) -> _Features:
        return _Features(self.place)

    def score(self, texts: list[str], features: _Features | None = None) -> np.ndarray:
        features = self.features() if features is None else features
        rows = [np.array(sorted({k for w in words_of(t) for k in features[w]}), np.int32) for t in texts]
        row, feature = _flat(rows)
        sums = _row_sums(row, self.factors[feature], len(rows))
        linear = np.bincount(row, self.weights[feature], len(rows)) if len(row) else np.zeros(len(rows))
        return _logistic(self.bias + linear + _pairs(row, self.factors, feature, sums))


def _row_sums(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(row, values[:, k], n) for k in range(values.shape[1])], 1) if len(row) else np.zeros((n, values.shape[1]))


def _pairs(row: np.ndarray, v: np.ndarray, feature: np.ndarray, sums: np.ndarray) -> np.ndarray:
    own = np.bincount(row, (v[feature] ** 2).sum(1), len(sums)) if len(row) else np.zeros(len(sums))
    return 0.5 * ((sums**2).sum(1) - own)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame) -> FactorizationMachine:
    """Fitted on the bounded sample of labelled rows that aren't held out."""
    known = labels.where("toxic in (0, 1)").where(~held_out("doc_id", FOLD, HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(FIT_TOXIC).unionAll(known.where("toxic = 0").orderBy(*order).limit(FIT_CLEAN))

    @F.pandas_udf("array<int>")
    def bucketed(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(terms)

    # the sample's ids are bounded, so they go to the texts and no text is shuffled
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", bucketed("text").alias("terms"))
    found = rows.toArrow().combine_chunks().sort_by("doc_id")
    y = found["toxic"].to_numpy().astype(float)
    per = {k: counts.get(k, 0) / max((y == k).sum(), 1) for k in (0, 1)}
    return FactorizationMachine.fit([t.values.to_numpy() for t in found["terms"]], y, np.where(y == 1, per[1], per[0]))


def scorer(model: FactorizationMachine):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = model.features()
        for texts in batches:
            yield pd.Series(model.score(texts.fillna("").tolist(), features), dtype=float)
        give_back()

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text), (doc_id, toxic) -> (doc_id, held_out, score, predicted)."""
    scored = docs.select("doc_id", held_out("doc_id", FOLD, HELD_OUT).alias("held_out"), scorer(fit(docs, labels))("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't toxic."""
    return docs.where(scorer(fit(docs, labels))("text") < 0.5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
