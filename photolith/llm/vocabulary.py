"""Counts of distinct strings over a corpus, and how a task gets at them: the frequent ones are broadcast, up to a
fixed number, and the rest is reached by a join on the string, where by construction no key is frequent.

Null and empty texts have no strings; tables without any give no rows, and nothing is broadcast then. Of equally frequent
strings all or none are. Texts are taken whole; a task holds ``HELD`` distinct strings or ``HELD_TOKENS`` words at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolith.llm.words import words_of

#: So many frequent strings are broadcast at most: tens of MB in a worker, whatever the corpus.
FREQUENT = 1 << 18
#: A worker holds so many distinct strings before it hands them on; Spark adds up what a task hands on before the shuffle.
HELD = 50_000
HELD_TOKENS = 500_000


def count_strings(docs: DataFrame, column: str, split: Callable[[str], Iterable], kind: str) -> DataFrame:
    """(piece ``kind``, n): how often ``split`` yields each string over all of ``docs``. Tasks add up before the shuffle."""
    arrow = pa.string() if kind == "string" else pa.binary()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), arrow), pa.array(held.values(), pa.int64())], ["piece", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held.update(split(text))
                    if len(held) > HELD:
                        yield out()
                        held.clear()
        if held:
            yield out()

    return docs.select(column).mapInArrow(tally, f"piece {kind}, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def count_words(docs: DataFrame, column: str) -> DataFrame:
    """(piece: a word's hash, ending: its last bytes, n): how often each word is in ``docs``. Null texts have none."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            pieces, endings = (np.concatenate(x) for x in zip(*held, strict=True))
            pieces, first, n = np.unique(pieces, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pieces.view(np.int64)), pa.array(endings[first], pa.int32()), pa.array(n, pa.int64())], ["piece", "ending", "n"])

        for batch in batches:
            held.append(words_of(batch.column(0))[:2])
            if sum(len(x[0]) for x in held) >= HELD_TOKENS:
                yield out()
                held.clear()
        if held:
            yield out()

    found = docs.select(column).mapInArrow(tally, "piece long, ending int, n long")
    return found.groupBy("piece").agg(F.max("ending").alias("ending"), F.sum("n").alias("n"))


class Lexicon:
    """Places of some words, by their hashes, with values for each."""

    BITS = 20

    def __init__(self, pieces: np.ndarray, **values: np.ndarray) -> None:
        order = np.argsort(pieces)
        pieces = pieces[order]
        self.values = {k: v[order] for k, v in values.items()}
        shelves = pieces >> np.uint64(64 - self.BITS)
        self._first = np.searchsorted(shelves, np.arange((1 << self.BITS) + 1)).astype(np.int32)
        self._longest = int(np.diff(self._first).max())
        self._pieces = np.concatenate([pieces, np.zeros(self._longest, np.uint64)])

    def find(self, pieces: np.ndarray) -> np.ndarray:
        """Each word's place in the values, or -1."""
        shelf = (pieces >> np.uint64(64 - self.BITS)).astype(np.int64)
        at, out = self._first[shelf], np.full(len(pieces), -1, np.int32)
        for _ in range(self._longest):
            same = self._pieces[at] == pieces
            out[same] = at[same]
            at += 1
        return np.where(out < len(self._pieces) - self._longest, out, -1)


def most_frequent(counts: DataFrame, columns: list[str], limit: int = FREQUENT) -> pa.Table:
    """The most frequent pieces with their ``columns`` (n among them or not), at most ``limit``, in descending order.

    They are all those from some frequency on, which a histogram of the frequencies' logarithms gives: nothing is sorted
    or merged in one task. Singletons aren't worth sending."""
    step = F.floor(F.log2("n") * 8).cast("int")
    found = sorted(((r[0], r[1]) for r in counts.where("n > 1").groupBy(step.alias("step")).count().collect()), reverse=True)
    least, total = None, 0
    for at, n in found:
        total += n
        if total > limit:
            break
        least = at
    kept = counts.where(F.lit(False)) if least is None else counts.where("n > 1").where(step >= least)
    return kept.select("piece", *[c for c in columns if c != "piece"], F.col("n").alias("_n")).toArrow().sort_by([("_n", "descending"), ("piece", "ascending")]).select(columns)
