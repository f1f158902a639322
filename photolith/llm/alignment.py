"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text, and which pairs do so most often.

Side A is a byte-level tokenizer of the tokenizers library, side B a sentencepiece model; both tile the bytes of a space
and the text. In each batch two ``merge_asof`` joins, keyed by document, find for every token's start the other side's
token that covers it. Two tokens that overlap do so from the later of their two starts on, so the union of both directions
has every overlap, once where pairs with equal starts are taken from one side only. Where starts are equal, so are the ends
before them; these cut the tokens into groups.

1. Texts are cut before runs of spaces, where both libraries always cut (not behind other white space, which the byte-level
   pattern joins with spaces); a worker lets the libraries encode each distinct cut of a batch once, and keeps some.
   Each text's distinct linked pairs go to the shared folder, four bytes each, with how often they are linked, and so do
   each task's counts of pairs.
2. Counts of pairs are summed by a groupBy; a B id's highest count follows from them.
3. Links of the most frequent pairs (a fixed number) are summed in the task by a broadcast table of that size; the others
   become rows (document, pair, number of links), which are joined to the counts and summed.

Nulls: a null text has no tokens, as an empty one and one whose tokens don't give its bytes back; a null id stays null. Rows
are told apart by their place in the encoded table, so repeated rows each get a row. Empty tables give no rows. Columns
besides doc_id and text are ignored, whatever their names. Texts are taken whole, of any length; a task holds texts of
``HELD_CHARS`` characters at once, or one text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith.llm.common import give_back, materialize, table
from photolith.llm.vocabulary import most_frequent

MARK = "▁"
#: Fixed value: characters with the Unicode property White_Space, but for the space.
OTHER_SPACE = r"\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f" +[^ ]*(?:(?<=[{OTHER_SPACE}]) +[^ ]*)*")
#: Fixed value: the pattern of byte-level pre-tokens.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ids are written with two bytes.
IDS = 1 << 16
HELD_CHARS = 400_000
#: A worker keeps so many cuts that it met lately, and as many from before.
HELD_CUTS = 200_000
#: Longer cuts are left to the tokenizers library, whose time grows less with a word's length.
SHORT_CUT = 500
HELD_PAIRS = 1_500_000


def byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    plain = {b for b in range(256) if chr(b).isprintable() and chr(b) != " "}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


#: Whether a cut ends with white space, which the byte-level pattern would join with what follows.
_ENDS_OPEN = re.compile(f"[{OTHER_SPACE}]\\Z").search


def _packed(ids: list[list[int]]) -> tuple[bytes, list[int]]:
    """All ids with two bytes each, and where each list's begin."""
    packed = np.fromiter(chain.from_iterable(ids), "<u2").tobytes()
    return packed, [0, *(2 * np.cumsum([len(x) for x in ids])).tolist()]


class Pair:
    """Both tokenizers, the bytes of their tokens, and the ids of cuts."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = SentencePieceProcessor(model_file=piece_path)
        of, n_a, n_b = byte_level(), self.a.get_vocab_size(), self.b.get_piece_size()
        if max(n_a, n_b) > IDS:
            raise ValueError("ids take more than two bytes")
        added = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [added[i].encode() if i in added else bytes(of[c] for c in self.a.id_to_token(i)) for i in range(n_a)]
        self.b_bytes = []
        for i in range(n_b):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
        self.a_length, self.b_length = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.fast = self._ranked(byte_path, set(added))
        self.cuts: dict[str, tuple[bytes, bytes, bool]] = {}
        self.before: dict[str, tuple[bytes, bytes, bool]] = {}

    def _ranked(self, path: str, added: set[int]):
        """The same tokenizer as ranks, which takes a fifth of the time; None where ids don't follow the merges' order or
        texts are cut by another pattern than the byte-level one."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        split, model = told.get("pre_tokenizer") or {}, told["model"]
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if told.get("normalizer") or {k: split.get(k, plain[k]) for k in plain} != plain or merged != sorted(merged):
            return None
        ranks = {raw: i for i, raw in enumerate(self.a_bytes) if i not in added}
        return tiktoken.Encoding(os.path.basename(path), pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def learn(self, cuts: set[str]) -> None:
        """Encodes cuts that aren't known yet, all at once."""
        if len(self.cuts) > HELD_CUTS:
            self.cuts, self.before = {}, self.cuts
        new = [c for c in cuts if c not in self.cuts]
        self.cuts.update({c: self.before[c] for c in new if c in self.before})
        new = [c for c in new if c not in self.before]
        together = [c for c in new if len(c) <= SHORT_CUT and not _ENDS_OPEN(c)] if self.fast else []
        apart = [c for c in new if len(c) > SHORT_CUT or _ENDS_OPEN(c)] if self.fast else new
        for some, encode in ((together, self._encode_together), (apart, self._encode_apart)):
            if some:
                self._add(some, encode)

    def _add(self, new: list[str], encode: Callable) -> None:
        raw = [c.encode() for c in new]
        a, a_upto = encode(new, raw)
        # the model puts the first space before a text itself, but not before none
        found = [ids or [self.b.piece_to_id(MARK)] for ids in self.b.encode([c[1:] for c in new], num_threads=1)]
        b, b_upto = _packed(found)
        whole = [True] * len(new)
        if b"".join([self.b_bytes[i] for i in chain.from_iterable(found)]) != b"".join(raw) or (np.diff(self._bytes_upto(b, b_upto, self.b_length)) != [len(r) for r in raw]).any():
            whole = [b"".join([self.b_bytes[i] for i in ids]) == r for ids, r in zip(found, raw, strict=True)]
        made = zip(a_upto, a_upto[1:], b_upto, b_upto[1:], whole)
        self.cuts.update(zip(new, ((a[i:j], b[k:m], w) for i, j, k, m, w in made), strict=True))

    @staticmethod
    def _bytes_upto(packed: bytes, upto: list[int], length: np.ndarray) -> np.ndarray:
        ends = np.concatenate([[0], np.cumsum(length[np.frombuffer(packed, "<u2")])])
        return ends[np.array(upto) // 2]

    def _encode_together(self, new: list[str], raw: list[bytes]) -> tuple[bytes, list[int]]:
        """Packed ids and where each cut's begin. All cuts are one text: between cuts there is a cut anyway."""
        ids = np.array(self.fast.encode_ordinary("".join(new)), "<u2")
        upto = np.concatenate([[0], np.cumsum(self.a_length[ids])])
        at = np.searchsorted(upto, np.cumsum([len(r) for r in raw]))
        return ids.tobytes(), [0, *(2 * at).tolist()]

    def _encode_apart(self, new: list[str], raw: list[bytes]) -> tuple[bytes, list[int]]:
        return _packed([e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)])

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """The packed ids of each text, empty where they don't give the bytes of a space and the text back."""
        cut = [_CUT.findall(" " + text) if text else [] for text in texts]
        self.learn({c for cuts in cut for c in cuts})
        out = []
        for text, cuts in zip(texts, cut, strict=True):
            made = [self.cuts[c] for c in cuts]
            a, b = b"".join([m[0] for m in made]), b"".join([m[1] for m in made])
            if not all([m[2] for m in made]):
                raw = f" {text}".encode()
                if any(b"".join([of[i] for i in np.frombuffer(x, "<u2")]) != raw for x, of in ((a, self.a_bytes), (b, self.b_bytes))):
                    a = b = b""
            out.append((a, b))
        return out


_pairs: dict[tuple[str, str], Pair] = {}


def tokenizer_pair(byte_path: str, piece_path: str) -> Pair:
    """One pair per worker."""
    if (byte_path, piece_path) not in _pairs:
        _pairs[byte_path, piece_path] = Pair(byte_path, piece_path)
    return _pairs[byte_path, piece_path]


class Alignment:
    """The tokens of a batch of documents, side by side.

    a, b: ids; a_of, b_of: each token's document; links: a token of each side, and their document; a_new, b_new: whether a
    token starts where one of the other side does, which is where a group starts."""

    def __init__(self, texts: list[tuple[bytes, bytes]], a_length: np.ndarray, b_length: np.ndarray) -> None:
        self.n = len(texts)
        (self.a, self.a_of, a), (self.b, self.b_of, b) = (self._side([t[k] for t in texts], of) for k, of in ((0, a_length), (1, b_length)))
        over_a = self._covering(a, b)
        over_b = self._covering(b, a)
        self.a_new, self.b_new = b["start"].to_numpy()[over_a] == a["start"].to_numpy(), a["start"].to_numpy()[over_b] == b["start"].to_numpy()
        later = np.flatnonzero(~self.b_new)
        self.link_a, self.link_b = np.concatenate([np.arange(len(a)), over_b[later]]), np.concatenate([over_a, later])
        self.link_of = np.concatenate([self.a_of, self.b_of[later]])

    @staticmethod
    def _side(packed: list[bytes], length: np.ndarray) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
        ids = np.frombuffer(b"".join(packed), "<u2")
        of = np.repeat(np.arange(len(packed)), [len(x) // 2 for x in packed])
        # offsets go on from document to document, and both sides have all bytes of each, so they are sorted as they are
        ends = np.cumsum(length[ids])
        return ids, of, pd.DataFrame({"doc": of, "start": ends - length[ids], "token": np.arange(len(ids))})

    @staticmethod
    def _covering(tokens: pd.DataFrame, others: pd.DataFrame) -> np.ndarray:
        """For each token the other side's token that covers its start."""
        return pd.merge_asof(tokens[["doc", "start"]], others, on="start", by="doc")["token"].to_numpy()

    def per_document(self, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, minlength=self.n)

    def distinct_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each document's distinct linked pairs (two ids as one number), how often each is linked, and where its pairs begin."""
        pairs = self.a[self.link_a].astype(np.int64) * IDS + self.b[self.link_b]
        found, n = np.unique(self.link_of << 32 | pairs, return_counts=True)
        return (found & (1 << 32) - 1).astype("<u4"), n.astype("<u4"), np.searchsorted(found, np.arange(self.n + 1) << 32)

    def group_digests(self) -> list[str]:
        """sha256 of ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        a_group, b_group = np.cumsum(self.a_new), np.cumsum(self.b_new)
        n = int(a_group[-1]) if len(a_group) else 0
        a_upto, b_upto = np.searchsorted(a_group, np.arange(n + 1), side="right"), np.searchsorted(b_group, np.arange(n + 1), side="right")
        # within a group A's tokens come first, then B's
        a_at, b_at = np.arange(len(self.a)) + b_upto[a_group - 1], np.arange(len(self.b)) + a_upto[b_group]
        n = len(self.a) + len(self.b)
        ids, marks = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[a_at], ids[b_at] = self.a, self.b
        marks[a_at[a_upto[1:] - 1]] = ord("|")
        marks[b_at[b_upto[1:] - 1]] = ord(";")
        cells = _WRITTEN[ids]
        cells[:, -1] = marks
        raw = cells[cells > 0].tobytes()
        # documents follow each other on both sides
        tokens = np.cumsum(self.per_document(self.a_of) + self.per_document(self.b_of))
        ends = np.concatenate([[0], np.cumsum(_WIDTH[ids])])[tokens].tolist()
        return [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip([0, *ends], ends)]


#: For every id of two bytes its five decimal digits, zero in front of the first, with room for a mark; and how many are written.
_DIGITS = np.arange(IDS)[:, None] // 10 ** np.arange(4, -1, -1) % 10 + ord("0")
_WRITTEN = np.where(np.arange(IDS)[:, None] >= [10**4, 10**3, 10**2, 10, 0, IDS], np.pad(_DIGITS, ((0, 0), (0, 1))), 0).astype(np.uint8)
_WIDTH = np.count_nonzero(_WRITTEN, axis=1) + 1

_PARTS = [
    ("row", pa.int64()), ("doc_id", pa.int64()), ("pairs", pa.binary()), ("links", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("piece", pa.int64()), ("n", pa.int64()),
]


def _binaries(values: np.ndarray, upto: np.ndarray) -> pa.Array:
    raw, at = values.tobytes(), (4 * upto).tolist()
    return pa.array([raw[x:y] for x, y in zip(at, at[1:])], pa.binary())


def _slices(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of neighbours of a size of ``most`` together, or of one."""
    at, held = 0, 0
    for k, size in enumerate(sizes):
        if k > at and held + size > most:
            yield slice(at, k)
            at, held = k, 0
        held += size
    if sizes:
        yield slice(at, len(sizes))


def encode(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(doc_id, text) -> a row per text with its distinct linked pairs, how often each is linked (four bytes each), numbers
    and groups, and rows (piece: a linked pair, n) with how often a task saw it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(byte_path, piece_path)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pairs = np.concatenate([h[0] for h in held])
            order = np.argsort(pairs)
            pairs = pairs[order]
            new = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
            n = np.add.reduceat(np.concatenate([h[1] for h in held])[order].astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
            return pairs[new], n

        def counted() -> pa.RecordBatch:
            found, n = merged()
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(n), k) for _, k in _PARTS[:9]), pa.array(found.astype(np.int64)), pa.array(n)], [x for x, _ in _PARTS])

        for batch in batches:
            texts = batch.column(2).to_pylist()
            for part in _slices([len(t or "") for t in texts], HELD_CHARS):
                packed = pair.encode([t or "" for t in texts[part]])
                found = Alignment(packed, pair.a_length, pair.b_length)
                numbers = [found.per_document(x) for x in (found.a_of, found.b_of, found.a_of[found.a_new], found.link_of)]
                pairs, links, upto = found.distinct_pairs()
                own = [*(batch.column(k)[part] for k in (0, 1)), *(_binaries(x, upto) for x in (pairs, links))]
                own += [*(pa.array(x, pa.int64()) for x in numbers), pa.array(found.group_digests(), pa.string()), *(pa.nulls(found.n, k) for _, k in _PARTS[9:])]
                yield pa.RecordBatch.from_arrays(own, [x for x, _ in _PARTS])
                held.append((pairs, links))
                if len(held) > 1 and sum(len(h[0]) for h in held) > HELD_PAIRS:
                    held[:] = [merged()]
                    if len(held[0][0]) > HELD_PAIRS // 2:
                        yield counted()
                        held.clear()
        if held:
            yield counted()
        give_back()

    schema = "row long, doc_id long, pairs binary, links binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, piece long, n long"
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(piece: a pair, n: its links over the corpus, best: whether no pair of its B id has more)."""
    counts = materialize(encoded.where("piece is not null").groupBy("piece").agg(F.sum("n").alias("n")), "pairs-counted")
    b = F.col("piece").bitwiseAND(F.lit(IDS - 1))
    # as many rows as the model has pieces, below IDS
    highest = counts.groupBy(b.alias("b_id")).agg(F.max("n").alias("highest"))
    return materialize(counts.withColumn("b_id", b).join(F.broadcast(highest), "b_id").select("piece", "n", (F.col("n") == F.col("highest")).alias("best")), "pairs")


def link_sums(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum)."""
    known = most_frequent(counts, ["piece", "n", "best"]).sort_by("piece")
    shared = encoded.sparkSession.sparkContext.broadcast(tuple(known.column(k).to_numpy() for k in range(3)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, n, best = shared.value
        for batch in batches:
            found = [(len(raw.as_py()), raw.as_py(), times.as_py()) for raw, times in zip(batch.column(1), batch.column(2), strict=True)]
            for part in _slices([x[0] for x in found], 4 * HELD_CHARS):
                sizes = np.array([x[0] // 4 for x in found[part]])
                codes, links = (np.frombuffer(b"".join([x[k] for x in found[part]]), "<u4").astype(np.int64) for k in (1, 2))
                of, upto = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([[0], np.cumsum(sizes)])
                place = np.searchsorted(pieces, codes)
                has = place < len(pieces)
                has[has] = pieces[place[has]] == codes[has]
                own, sums = batch.column(0)[part], []
                for values in (best, n):  # whole numbers, so sums up to a document are subtracted exactly
                    each = np.zeros(len(codes) + 1, np.int64)
                    each[1:][has] = values[place[has]] * links[has]
                    sums.append(pa.array(np.diff(np.cumsum(each)[upto])))
                yield _sums(own, sums, [pa.nulls(len(sizes), pa.int64())] * 2)
                if not has.all():
                    rare = np.flatnonzero(~has)
                    yield _sums(own.take(pa.array(of[rare])), [pa.nulls(len(rare), pa.int64())] * 2, [pa.array(codes[rare]), pa.array(links[rare])])
        give_back()

    texts = encoded.where("piece is null").select("row", "pairs", "links")
    parts = texts.mapInArrow(rows, "row long, n_best long, count_sum long, piece long, freq long")
    # rows of frequent pairs have a key of their own, so that they spread evenly
    parts = parts.withColumn("piece", F.coalesce("piece", -1 - F.col("row")))
    joined = parts.join(counts, "piece", "left")
    links = F.coalesce("freq", F.lit(0))
    return joined.groupBy("row").agg(
        F.sum(F.coalesce("n_best", F.when(F.col("best"), links), F.lit(0))).alias("n_best"), F.sum(F.coalesce("count_sum", links * F.col("n"), F.lit(0))).alias("count_sum")
    )


def _sums(row: pa.Array, known: list[pa.Array], rare: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([row, *known, *rare], ["row", "n_best", "count_sum", "piece", "freq"])


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    encoded = materialize(encode(docs, byte_path, piece_path), "aligned-texts", compression="zstd")
    sums = link_sums(encoded, pair_counts(encoded))
    texts = encoded.where("piece is null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return texts.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
