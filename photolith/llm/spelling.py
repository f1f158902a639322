"""Spelling variants: words one edit apart, grouped under the form that is at least ten times as frequent.

Words are letter runs with their counts over the whole corpus. Which two are one edit apart is found in a reduced alphabet:

1. Letters are hashed to ``SYMBOLS`` symbols. If two words are one edit apart, so are their reduced words, or these are equal.
2. The full one-edit neighbourhood of each reduced word is generated (itself, deletions, replacements, insertions, each
   string once) as 64-bit hashes, in time that grows with a word's length only. Neighbours that are no reduced word of the
   vocabulary are left out at once by a bitmap of fixed size, which a task gets by broadcast; it never leaves out a true one.
3. The others are joined to the reduced vocabulary, and the join's condition verifies the original strings.

Where more than ``HOT`` words share a reduced word, that reduced word takes no part in the join. The words with it, and
those with it in their neighbourhood, are joined anew with all letters as symbols, where a reduced word is one word. So a
row of a neighbourhood meets ``HOT`` words at most, and nothing is lost.

A word's form is its near word of the largest count (ties: the smallest in code-point order), if that count is at least
``RATIO`` times its own; its root is found by following forms to the last. Counts grow at least tenfold from form to form,
so a few doublings reach the root.

Nulls: a null text has no words; a null id counts as the empty text where ids are hashed. Repeated rows count each. Tables
without words give no rows. Columns besides doc_id and text are ignored, whatever their names. Texts and words are taken
whole, of any length; a task holds ``HELD`` distinct words and ``CELLS`` hashes at once, or those of one word's length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith.llm.common import discard, materialize, table
from photolith.llm.words import mix

#: Fixed value: letters of the contract.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
SHORTEST, LEAST, RATIO, CUT = 7, 2, 10, 31
SYMBOLS = 8
LETTERS = 1 << 8
HOT = 256
FILTER_BITS = 27
HELD = 50_000
CELLS = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = mix(np.arange(1, LETTERS + 1, dtype=np.uint64))


def words_of(doc_id: int | None, text: str | None) -> Counter:
    """The words of one text with their counts: letter runs, A-Z lower-cased, some with a letter deleted by a hash of id and run."""
    found: Counter = Counter()
    begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall((text or "").encode().lower().decode())).items():
        if len(run) < SHORTEST:
            continue
        h = zlib.crc32(run.encode(), begin)
        if h % CUT == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < SHORTEST:
                continue
        found[run] += n
    return found


def vocabulary(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (word, n) with at least ``LEAST`` occurrences. Tasks add up before the shuffle."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.update(words_of(doc_id, text.as_py()))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tally, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.ones((2, n + 1), np.uint64)
    for row, step in zip(out, (_BASE, _INVERSE), strict=True):
        np.multiply.accumulate(np.full(n, step, np.uint64), out=row[1:])
    return out[0], out[1]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points as a matrix) of the words of one length at a time."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == n)
        for part in np.array_split(places, max(1, len(places) * n * 32 // CELLS)):
            if len(part):
                points = np.frombuffer("".join([words[k] for k in part]).encode("utf-32-le"), np.uint32)
                yield part, points.reshape(len(part), n)


def _prefixes(symbols: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of the rows: sums of the symbols' values times powers of an odd base."""
    out = np.zeros((len(symbols), symbols.shape[1] + 1), np.uint64)
    np.cumsum(_VALUES[symbols] * power[:-1], axis=1, out=out[:, 1:])
    return out


def reduced(words: list[str], symbols: int) -> np.ndarray:
    """The hash of each word's reduced word."""
    out = np.zeros(len(words), np.uint64)
    for places, points in _by_length(words):
        n = points.shape[1]
        out[places] = mix(_prefixes(points % symbols, _powers(n)[0])[:, -1] + _U(n))
    return out


def neighbourhoods(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the word, hash of a neighbour of its reduced word), each neighbour once.

    Of a run of equal symbols only the first is deleted, and no symbol is put behind its like, so no string comes twice."""
    values = np.arange(symbols)
    for places, points in _by_length(words):
        s = points % symbols
        n = s.shape[1]
        power, _ = _powers(n)
        before = _prefixes(s, power)
        whole, cells = before[:, -1:], max(1, CELLS // (symbols * len(s)))
        yield places, mix(whole[:, 0] + _U(n))
        for at in range(0, n + 1, cells):
            i = np.arange(at, min(n, at + cells))
            if len(i):
                first = np.ones((len(s), len(i)), bool)
                first[:, i > 0] = s[:, i[i > 0]] != s[:, i[i > 0] - 1]
                row, col = np.nonzero(first)
                yield places[row], mix(before[row, i[col]] + (whole[row, 0] - before[row, i[col] + 1]) * _U(_INVERSE) + _U(n - 1))
                # every symbol but its own
                row, col, c = np.nonzero(s[:, i, None] != values)
                yield places[row], mix(whole[row, 0] + (_VALUES[c] - _VALUES[s[row, i[col]]]) * power[i[col]] + _U(n))
            i = np.arange(at, min(n + 1, at + cells))
            fits = np.ones((len(s), len(i), symbols), bool)
            fits[:, i > 0] = s[:, i[i > 0] - 1, None] != values
            row, col, c = np.nonzero(fits)
            head = before[row, i[col]]
            yield places[row], mix(head + _VALUES[c] * power[i[col]] + (whole[row, 0] - head) * _U(_BASE) + _U(n + 1))


def _keyed(words: DataFrame, symbols: int) -> DataFrame:
    """(word, n) -> (key: hash of the reduced word, word, n)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = reduced(batch.column(0).to_pylist(), symbols)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0), batch.column(1)], ["key", "word", "n"])

    return words.select("word", "n").mapInArrow(rows, "key long, word string, n long")


def _bitmap(keyed: DataFrame) -> np.ndarray:
    """A bit for the first ``FILTER_BITS`` bits of every key; its size is fixed."""
    place = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - FILTER_BITS}) & 63 as int))")
    found = keyed.select(F.shiftright(place, 6).cast("int").alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out.view(np.uint64)


def _neighbours(keyed: DataFrame, symbols: int) -> DataFrame:
    """(key of a neighbour, word): only keys that the vocabulary may have."""
    shared = keyed.sparkSession.sparkContext.broadcast(_bitmap(keyed))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, keys in neighbourhoods(batch.column(0).to_pylist(), symbols):
                bit = keys >> _U(64 - FILTER_BITS)
                kept = np.flatnonzero(shared.value[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63)) & _U(1))
                if len(kept):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[kept].view(np.int64)), batch.column(0).take(pa.array(place[kept]))], ["key", "word"])

    return keyed.select("word").mapInArrow(rows, "key long, word string")


def near_words(words: DataFrame, symbols: int = SYMBOLS, hot: int = HOT) -> DataFrame:
    """(word, n), distinct words -> (word, near, near_n): all ordered pairs one edit apart."""
    keyed = materialize(_keyed(words, symbols), "spelling-reduced")
    others = keyed.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    neighbours = _neighbours(keyed, symbols)
    apart = F.expr("word <> near AND levenshtein(word, near, 1) = 1")
    many = keyed.groupBy("key").agg(F.count("*").alias("shared")).where(F.col("shared") > hot).select("key")
    if symbols >= LETTERS or many.isEmpty():
        return materialize(neighbours.join(others, "key").where(apart).select("word", "near", "near_n").distinct(), "spelling-near")
    many = materialize(many, "spelling-hot")
    neighbours = materialize(neighbours, "spelling-neighbours")
    found = neighbours.join(others.join(many, "key", "left_anti"), "key").where(apart).select("word", "near", "near_n")
    meet = neighbours.join(many, "key", "left_semi").select("word").distinct()
    again = near_words(words.join(meet, "word", "left_semi"), LETTERS, hot)
    found = materialize(found.unionAll(again).distinct(), "spelling-near")
    discard(neighbours, many)
    return found


def roots(forms: DataFrame, doublings: int) -> DataFrame:
    """(word, form), forms without loops -> (word, root): forms followed over 2^doublings steps."""
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(doublings):
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        found = materialize(found.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "spelling-roots")
    return found


def spelling_variants(docs: DataFrame, symbols: int = SYMBOLS, hot: int = HOT) -> DataFrame:
    """(doc_id, text) -> (word, form, root, n, n_near, form_n), one row per word."""
    words = materialize(vocabulary(docs), "spelling-words")
    near = near_words(words, symbols, hot)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= RATIO * F.col("n")
    told = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    told = materialize(told, "spelling-forms")
    # from form to form counts grow by RATIO at least
    steps, n = 0, words.agg(F.max("n")).first()[0] or 0
    while n >= LEAST * RATIO ** (steps + 1):
        steps += 1
    last = roots(told.where("form is not null"), max(0, steps - 1).bit_length())
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
