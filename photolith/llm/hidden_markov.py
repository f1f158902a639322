"""A hidden Markov language model of documents.

Tokens are words, A-Z lower-cased, then one end. The model has ``STATES`` latent states with transition probabilities,
and each state emits symbols: the ``OWN`` most frequent words, the end, and ``CLASSES`` classes for all other words (by
the last three bytes, so that words with one ending share a class). Within a class a word has its add-one share, with
one unknown word per class, so that the probabilities of all texts sum to one. The states' emissions are bounded, and so
is the model; the counts of words, which give the shares, grow with the corpus. Words are told apart by 64-bit hashes.

Training: counts of all training tokens (a groupBy). Texts are encoded once to symbols, in the shared folder. The start
is fitted to the counts of all neighbours in all training texts, an end standing before the first token too: the most
frequent words and the end are told apart in them, the others by their endings, so that these counts are ``PLACES`` ^ 2
numbers whatever the corpus, and ``START_ROUNDS`` rounds of Baum-Welch over neighbours take no further pass. Then
follow ``ROUNDS`` rounds over all training texts, whole, each task summing its expected counts before they
are shuffled by symbol. Emissions are smoothed with the symbols' shares in the training tokens, by which also the unknown
get theirs.

Scoring: the scaled forward recursion, in double precision, gives the exact log-likelihood of a text's symbols. Words
beyond the broadcast ones (a fixed number) are rows (document, word, frequency) that are joined to the counts and summed
per document, which gives the base score, the known tokens and the shares within classes.

Nulls: a null text counts as empty, one end token; a null id is hashed as ''. Rows are told apart by their place in the
encoded table, so repeated rows each get a row. Without training rows all words are unknown. Empty tables give no rows.
Columns besides doc_id and text are ignored. A task holds ``HELD_TOKENS`` tokens at once, or one text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith.llm.common import held_out, materialize, table
from photolith.llm.vocabulary import Lexicon, count_words, most_frequent
from photolith.llm.words import utf8, words_of

STATES = 8
CLASSES = 512
END = 0
#: So that a symbol takes two bytes.
OWN = (1 << 16) - 1 - CLASSES
SYMBOLS = 1 + CLASSES + OWN
#: In counts of neighbours: so many places, of which so many are for endings.
PLACES, ENDINGS = 256, 64
START_ROUNDS = 200
ROUNDS = 3
SMOOTH = 50.0
FOLD, HELD_OUT = 7, 2
#: So many tokens are in the arrays of the recursions at once. Texts above LONG go side by side with their like only.
HELD_TOKENS = 700_000
LONG = 2000
START_WORDS = LONG


def word_class(endings: np.ndarray) -> np.ndarray:
    """The classes of words by their last three bytes as numbers."""
    return ((endings.astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CLASSES.bit_length() + 1)).astype(np.int32)


class Stack:
    """Texts side by side, longest first: the symbols of one time after those of the time before, so no cell is empty."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        lengths = np.array([len(t) for t in texts], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        times = int(lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-lengths, -np.arange(1, times + 1), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        self.text = np.repeat(np.arange(len(lengths)), lengths)
        time = np.arange(len(self.text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = self.at[time] + self.text
        self.symbols = np.empty(len(place), np.int64)
        self.symbols[place] = np.concatenate([texts[k] for k in self.order]) if len(place) else []
        column = np.empty(len(place), np.int64)
        column[place] = self.text
        self.text = column


class HiddenMarkovModel:
    """start: (states); move: (states, states), rows sum to 1; emit: (symbols, states), columns sum to 1."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, np.ascontiguousarray(emit, np.float64)

    @classmethod
    def first(cls, shares: np.ndarray, seed: int = 5) -> HiddenMarkovModel:
        """Every state near the shares of the symbols, each a little elsewhere."""
        random = np.random.default_rng(seed)
        emit = shares[:, None] * random.gamma(1.0, 1.0, (len(shares), STATES))
        move = np.full((STATES, STATES), 0.4 / STATES) + 0.6 * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihood of each text."""
        stack = Stack(texts)
        _, scales = self._forward(stack)
        out = np.empty(len(texts))
        out[stack.order] = np.bincount(stack.text, np.log10(scales), len(texts))
        return out

    def _forward(self, stack: Stack) -> tuple[np.ndarray, np.ndarray]:
        """Scaled states and scales, in the stack's order."""
        states = self.emit[stack.symbols]
        scales = np.empty(len(states))
        ends = stack.at.tolist()
        state = None
        for t, k in enumerate(stack.active.tolist()):
            here = states[ends[t] : ends[t + 1]]
            here *= self.start if t == 0 else state[:k] @ self.move
            scale = here.sum(1, out=scales[ends[t] : ends[t + 1]])
            here /= scale[:, None]
            state = here
        return states, scales

    def expected(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch counts of ``texts``: starts, moves, emissions by symbol and state; the log10 likelihood."""
        stack = Stack(texts)
        states, scales = self._forward(stack)
        coming = self.emit[stack.symbols]
        coming /= scales[:, None]
        moves, ends, active, back = np.zeros((STATES, STATES)), stack.at.tolist(), stack.active.tolist(), None
        to = np.ascontiguousarray(self.move.T)
        for t in range(len(active) - 1, -1, -1):
            here = states[ends[t] : ends[t + 1]]
            if back is not None:
                k = active[t + 1]
                after = coming[ends[t + 1] : ends[t + 2]]
                after *= back
                moves += here[:k].T @ after
                back = after @ to
                if active[t] > k:
                    back = np.concatenate([back, np.ones((active[t] - k, STATES))])
                here *= back
            else:
                back = np.ones_like(here)
        emits = np.stack([np.bincount(stack.symbols, states[:, s], SYMBOLS) for s in range(STATES)], 1)
        starts = states[: ends[1]].sum(0) if active else np.zeros(STATES)
        return starts, moves * self.move, emits, float(np.log10(scales).sum())

    @classmethod
    def from_counts(cls, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, shares: np.ndarray) -> HiddenMarkovModel:
        emit = emits + SMOOTH * shares[:, None]
        return cls((starts + 1) / (starts.sum() + STATES), (moves + 1) / (moves.sum(1) + STATES)[:, None], emit / emit.sum(0))


def in_stacks(texts: Iterator[tuple], work: Callable[[list[tuple]], Iterator]) -> Iterator:
    """Hands ``work`` lists of (text, ...) with a bounded number of tokens, long texts apart from short ones: a recursion
    takes as many steps as its longest text has tokens."""
    held: tuple[list, list] = [], []
    sizes = [0, 0]
    for row in texts:
        kind = int(len(row[0]) > LONG)
        held[kind].append(row)
        sizes[kind] += len(row[0])
        if sizes[kind] >= HELD_TOKENS:
            yield from work(held[kind])
            held[kind].clear()
            sizes[kind] = 0
    for rows in held:
        if rows:
            yield from work(rows)


class TrainedModel:
    """What the words' counts say: symbols, class sizes, and the numbers of the base score."""

    def __init__(self, counts: DataFrame, n_texts: int) -> None:
        self.counts = counts
        own = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        # the end is a token too, once per training text
        self.n = (own["n"] or 0) + n_texts
        self.v = own["v"] + (1 if n_texts else 0)
        self.n_end = n_texts
        known = most_frequent(counts, ["piece", "ending", "n"])
        pieces, n = known.column(0).to_numpy().view(np.uint64), known.column(2).to_numpy().astype(float)
        of = word_class(known.column(1).to_numpy())
        self.class_n, self.class_v = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in counts.groupBy(class_column("ending").alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            self.class_n[r["class"]], self.class_v[r["class"]] = r["n"], r["v"]
        np.subtract.at(self.class_n, of[:OWN], n[:OWN])
        np.subtract.at(self.class_v, of[:OWN], 1)
        self.class_total = self.class_n + self.class_v + 1
        shares = np.zeros(SYMBOLS)
        shares[END] = n_texts + 1
        shares[1 : 1 + CLASSES] = self.class_total
        shares[1 + CLASSES : 1 + CLASSES + min(len(n), OWN)] = n[:OWN] + 1
        self.shares = shares / shares.sum()
        self.places = PLACES - ENDINGS + np.arange(-1, SYMBOLS - 1) % ENDINGS
        self.places[1 + CLASSES : 1 + CLASSES + min(len(n), OWN)] = PLACES - ENDINGS + of[:OWN] % ENDINGS
        self.places[1 + CLASSES : 1 + CLASSES + min(len(n), PLACES - ENDINGS - 1)] = np.arange(1, 1 + min(len(n), PLACES - ENDINGS - 1))
        self.places[END] = 0
        symbol = 1 + of
        symbol[:OWN] = np.arange(1 + CLASSES, 1 + CLASSES + min(len(n), OWN))
        total = float(self.n + self.v + 1)
        in_class = np.log10((n + 1) / self.class_total[of])
        in_class[:OWN] = 0  # these have symbols of their own
        self.base_total, self.base_end = total, float(np.log10((n_texts + 1) / total))
        self.lexicon = Lexicon(pieces, symbol=symbol.astype(np.uint16), base=np.log10((n + 1) / total), in_class=in_class)


def class_column(ending: str):
    return F.shiftright(F.col(ending).cast("long") * 0x9E3779B1 % (1 << 32), 32 - CLASSES.bit_length() + 1).cast("int")


def encode(docs: DataFrame, trained: TrainedModel) -> DataFrame:
    """(doc_id, text, train) -> a row per text: (row, doc_id, train, symbols: two bytes each, n_tokens, known, base, extra), and
    rows (row, piece, ending, freq) of the words that aren't broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((trained.lexicon, trained.n_end, trained.base_end))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, n_end, base_end = shared.value
        for batch in batches:
            pieces, endings, first = words_of(batch.column(3))
            place = lexicon.find(pieces)
            known = place >= 0
            symbols = (1 + word_class(endings)).astype(np.uint16)
            symbols[known] = lexicon.values["symbol"][place[known]]
            n = len(first) - 1
            of = np.repeat(np.arange(n), np.diff(first))
            # without a known word in the batch bincount gives integers, whatever the weights are
            sums = [np.bincount(of[known], lexicon.values[x][place[known]], n).astype(np.float64) for x in ("base", "in_class")]
            n_known = np.bincount(of[known], minlength=n) + int(n_end > 0)
            ends = [END.to_bytes(2, "little")]
            packed = [b"".join([symbols[a:b].tobytes(), *ends]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            own = [batch.column(0), batch.column(1), batch.column(2), pa.array(packed, pa.binary()), pa.array(np.diff(first) + 1, pa.int64())]
            own += [pa.array(n_known, pa.int64()), pa.array(sums[0] + base_end), pa.array(sums[1]), *(pa.nulls(n, k) for _, k in _PARTS[8:])]
            yield pa.RecordBatch.from_arrays(own, [x for x, _ in _PARTS])
            rare = np.flatnonzero(~known)
            if len(rare):
                order = rare[np.lexsort((pieces[rare], of[rare]))]
                new = np.flatnonzero(np.concatenate([[True], (of[order[1:]] != of[order[:-1]]) | (pieces[order[1:]] != pieces[order[:-1]])]))
                freq, order = np.diff(np.append(new, len(order))), order[new]
                ids = batch.column(0).to_numpy()[of[order]]
                columns = [pa.array(ids), *(pa.nulls(len(order), k) for _, k in _PARTS[1:8]), pa.array(pieces[order].view(np.int64)), pa.array(endings[order], pa.int32()), pa.array(freq, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [x for x, _ in _PARTS])

    schema = "row long, doc_id long, train boolean, symbols binary, n_tokens long, known long, base double, extra double, piece long, ending int, freq long"
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "train", "text").mapInArrow(rows, schema)


_PARTS = [
    ("row", pa.int64()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("symbols", pa.binary()), ("n_tokens", pa.int64()), ("known", pa.int64()),
    ("base", pa.float64()), ("extra", pa.float64()), ("piece", pa.int64()), ("ending", pa.int32()), ("freq", pa.int64()),
]


def symbols_of(raw: pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw.as_py(), np.uint16)


def count(docs: DataFrame) -> TrainedModel:
    """From (doc_id, text, train) the counts of the training rows."""
    training = docs.where("train")
    counts = materialize(count_words(training, "text"), "word-counts")
    return TrainedModel(counts, training.count())


def fit(encoded: DataFrame, trained: TrainedModel) -> tuple[HiddenMarkovModel, int]:
    """The model of the training rows, and how many rounds of Baum-Welch over all of them it took."""
    training = encoded.where("train")
    model, rounds = HiddenMarkovModel.first(trained.shares), 0
    if trained.n_end:
        model = start_of(neighbours(training, trained.places), trained)
        for _ in range(ROUNDS):
            model, rounds = _round(training, model, trained.shares), rounds + 1
    return model, rounds


def neighbours(training: DataFrame, places: np.ndarray) -> np.ndarray:
    """How often each place stands before each, in all training texts; an end stands before each text."""
    shared = training.sparkSession.sparkContext.broadcast(places)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(PLACES * PLACES, np.int64)
        for batch in batches:
            # every text ends in an end, which then stands before the next one
            symbols, before = utf8(batch.column(0))[0].view(np.uint16), END
            for at in range(0, len(symbols), HELD_TOKENS):
                place = shared.value[np.concatenate([[before], symbols[at : at + HELD_TOKENS]])]
                sums += np.bincount(place[:-1] * PLACES + place[1:], minlength=len(sums))
                before = symbols[min(at + HELD_TOKENS, len(symbols)) - 1]
        pair = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(sums[pair])], ["pair", "n"])

    found = training.select("symbols").mapInArrow(tally, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(PLACES * PLACES)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    shared.unpersist()
    return out.reshape(PLACES, PLACES)


def start_of(counts: np.ndarray, trained: TrainedModel, seed: int = 5) -> HiddenMarkovModel:
    """The model whose neighbours are likeliest, by Baum-Welch over all of them; symbols of one place share its emissions."""
    shares = np.bincount(trained.places, trained.shares, PLACES)
    emit = shares[:, None] * np.random.default_rng(seed).gamma(1.0, 1.0, (PLACES, STATES))
    emit /= emit.sum(0)
    both = (np.full((STATES, STATES), 0.4 / STATES) + 0.6 * np.eye(STATES)) / STATES  # of the states of two neighbours
    for _ in range(START_ROUNDS):
        move = both / both.sum(1)[:, None]
        first, second = emit * both.sum(1), emit @ move.T
        chance = first @ second.T
        part = np.divide(counts, chance, out=np.zeros_like(counts), where=counts > 0)
        emits = first * (part @ second) + emit * (part.T @ first @ move)
        both = both * (emit.T @ part @ emit) + 1e-3
        both /= both.sum()
        emit = emits + SMOOTH * shares[:, None]
        emit /= emit.sum(0)
    move = both / both.sum(1)[:, None]
    start = (emit[trained.places[END]] * both.sum(1)) @ move
    of = trained.shares / np.maximum(shares, 1e-300)[trained.places]
    full = emit[trained.places] * of[:, None]
    return HiddenMarkovModel(start / start.sum(), move, full / full.sum(0))


def _round(training: DataFrame, model: HiddenMarkovModel, shares: np.ndarray) -> HiddenMarkovModel:
    """One round of Baum-Welch over all training texts. Symbols -1 and -2... carry starts and moves."""
    shared = training.sparkSession.sparkContext.broadcast(model)
    names = [f"s{k}" for k in range(STATES)]

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, moves, sums = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((SYMBOLS, STATES))

        def add(rows: list[tuple]) -> Iterator[int]:
            s, m, by_symbol, _ = shared.value.expected([r[0] for r in rows])
            np.add(starts, s, out=starts)
            np.add(moves, m, out=moves)
            np.add(sums, by_symbol, out=sums)
            yield len(rows)

        if sum(in_stacks(((symbols_of(raw),) for batch in batches for raw in batch.column(0)), add)):
            seen = np.flatnonzero(sums.any(1))
            rows = np.concatenate([starts[None], moves, sums[seen]])
            keys = np.concatenate([-np.arange(1, STATES + 2), seen])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(rows[:, k]) for k in range(STATES))], ["symbol", *names])

    schema = "symbol int, " + ", ".join(f"{x} double" for x in names)
    # the sums are rounded, so that the order in which tasks end doesn't show
    added = training.select("symbols").mapInArrow(expected, schema).groupBy("symbol").agg(*[F.sum(F.col(x)).alias(x) for x in names])
    found = added.toArrow()
    keys, rows = found.column(0).to_numpy(), np.column_stack([found.column(k + 1).to_numpy() for k in range(STATES)])
    rows = np.round(rows, 6)
    inner = {int(k): r for k, r in zip(keys[keys < 0], rows[keys < 0], strict=True)}
    emits = np.zeros((SYMBOLS, STATES))
    emits[keys[keys >= 0]] = rows[keys >= 0]
    shared.unpersist()
    return HiddenMarkovModel.from_counts(inner[-1], np.stack([inner[-2 - k] for k in range(STATES)]), emits, shares)


def score_texts(encoded: DataFrame, trained: TrainedModel, model: HiddenMarkovModel) -> DataFrame:
    """The encoded table -> (doc_id, n_tokens, n_known, base_score, score)."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def score(texts: list[tuple]) -> Iterator[pa.RecordBatch]:
            found = shared.value.log10([t[0] for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array([t[1] for t in texts], pa.int64()), pa.array(found)], ["row", "hmm"])

        rows_of = ((symbols_of(raw), row) for batch in batches for row, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        yield from in_stacks(rows_of, score)

    texts = encoded.where("symbols is not null")
    hmm = texts.select("row", "symbols").mapInArrow(rows, "row long, hmm double")
    sizes = spark.createDataFrame([(k, float(n)) for k, n in enumerate(trained.class_total)], "class int, class_total double")
    c = F.coalesce("n", F.lit(0))
    rare = encoded.where("piece is not null").select("row", "piece", class_column("ending").alias("class"), "freq")
    rare = rare.join(trained.counts.select("piece", "n"), "piece", "left").join(F.broadcast(sizes), "class")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("freq")).otherwise(0)).alias("more_known"),
        F.sum(F.col("freq") * F.log10((c + 1) / trained.base_total)).alias("more_base"),
        F.sum(F.col("freq") * F.log10((c + 1) / F.col("class_total"))).alias("more_extra"),
    )
    or_0 = lambda x: F.coalesce(x, F.lit(0))
    return (
        texts.select("row", "doc_id", "n_tokens", "known", "base", "extra").join(hmm, "row").join(rare, "row", "left")
        .select(
            "doc_id", "n_tokens", (F.col("known") + or_0("more_known")).cast("long").alias("n_known"),
            (F.col("base") + or_0("more_base")).alias("base_score"), (F.col("hmm") + F.col("extra") + or_0("more_extra")).alias("score"),
        )
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    docs = docs.select("doc_id", "text", (~held_out("doc_id", FOLD, HELD_OUT)).alias("train"))
    trained = count(docs)
    encoded = materialize(encode(docs, trained), "encoded-texts")
    model, _ = fit(encoded, trained)
    return score_texts(encoded, trained, model).select(
        "doc_id", held_out("doc_id", FOLD, HELD_OUT).alias("held_out"), "n_tokens", "n_known",
        F.lit(trained.n).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op8_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
