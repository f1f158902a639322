"""SentencePiece encoding and decoding with a prefix table.

The model is a merge-type (BPE) model: an encoding is right exactly if every two neighbours in it are compatible, that
is, if merging their joined text gives these two pieces again. So every prefix of a text has one encoding, and with it
one last token. An automaton reports all pieces that end at each character; the one piece that is compatible with the
last token of the prefix before it is that character's entry, and the ids are recovered from the end backwards.

No piece holds a space mark after another character, so texts are cut before each run of space marks and a worker
keeps the cuts it met last, in a cache of bounded size. Cuts of up to ``SHORT`` characters are encoded many at once: their
prefix tables grow side by side, a character at a time, over the matches that one walk down the trie of the pieces
gives for all places. Longer ones, and those with byte pieces, are encoded one by one. Characters outside the model become byte pieces and never
merge, so they cut too.

Nulls: a null text counts as empty and has the end id only. Repeated rows are encoded each. Empty tables give no rows.
Columns besides doc_id and text are ignored, whatever their names. Texts are taken whole, of any length.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith.llm.common import give_back, table

MARK = "▁"
#: A task holds so many distinct cuts at most, and a worker so many pairs of pieces; and the ends of pieces that were met.
HELD = 80_000
SHORT = 40
#: So many cuts are encoded at once, and those of texts with about so many cuts are looked up at once.
AT_ONCE = 10_000
LOOKED_UP = 50_000
PAIR_PLACES = 1_048_573
_NEVER = float("inf")
_CUT = re.compile(f"{MARK}+[^{MARK}]*")


class _Trie:
    """The pieces' trie as a hash table of steps (node, character) -> node, which many places of a text go down at once."""

    BITS = 19

    def __init__(self, pieces: dict[str, int]) -> None:
        nodes, steps = {"": 0}, []
        for piece in pieces:
            for n in range(1, len(piece) + 1):
                if piece[:n] not in nodes:
                    nodes[piece[:n]] = len(nodes)
                    steps.append(nodes[piece[: n - 1]] << 21 | ord(piece[n - 1]))
        self.piece = np.full(len(nodes), -1)
        for piece, i in pieces.items():
            self.piece[nodes[piece]] = i
        while len(steps) >= 1 << self.BITS - 1:
            self.BITS += 1
        self.steps, self.node = np.full(1 << self.BITS, -1, np.int64), np.zeros(1 << self.BITS, np.int32)
        for node, (step, at) in enumerate(zip(steps, self._places(np.array(steps, np.int64)).tolist(), strict=True), 1):
            while self.steps[at] >= 0:
                at = (at + 1) % len(self.steps)
            self.steps[at], self.node[at] = step, node

    def _places(self, steps: np.ndarray) -> np.ndarray:
        return (steps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _down(self, steps: np.ndarray) -> np.ndarray:
        """The node after each step, 0 where there is none."""
        at = self._places(steps)
        found = self.steps[at]
        out = np.where(found == steps, self.node[at], 0)
        todo = np.flatnonzero((found != steps) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.steps)
            found = self.steps[at[todo]]
            same = found == steps[todo]
            out[todo[same]] = self.node[at[todo[same]]]
            todo = todo[~same & (found >= 0)]
        return out

    def matches(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, id) of all pieces in ``chars``; from a place they reach to its entry in ``ends`` at most."""
        chars = chars.astype(np.int64)
        at, node, length, out = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0, []
        while len(at):
            node = self._down(node << 21 | chars[at + length])
            length += 1
            at, node = at[node > 0], node[node > 0].astype(np.int64)
            piece = self.piece[node]
            has = piece >= 0
            out.append((at[has], np.full(int(has.sum()), length), piece[has]))
            more = at + length < ends[at]
            at, node = at[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class PieceModel:
    """Pieces, scores and byte pieces of a model file, with what the prefix table needs."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.end = model.eos_id()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i in range(size) if model.is_control(i)}
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.cost = {i: -model.get_score(i) for i in plain}
        self.find = ahocorasick.Automaton()
        self.edges: dict[int, tuple[list, list]] = {}
        #: Of pairs of pieces met, twice their number and whether they are compatible, each at the one place that is its own.
        self.pairs = np.full(PAIR_PLACES, -1, np.int64)
        self.length = [len(p) for p in self.pieces]
        self.names = [str(i) for i in range(size)]
        #: What a piece reads as; byte pieces have no text of their own.
        self.spoken = [None if i in self.bytes_of else "" if i in self.silent else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        for i in plain:
            if len(self.merges(self.pieces[i])[0]) == 1:  # a piece that merging its own text never gives is never a token
                self.find.add_word(self.pieces[i], (i, self.length[i]))
        self.find.make_automaton()
        self.trie = _Trie({text: i for i, text in enumerate(self.pieces) if text in self.find and self.ids.get(text) == i})
        self.lengths = np.array(self.length)

    def merges(self, text: str) -> tuple[list[str], list[tuple[float, int, int]]]:
        """Merges ``text`` from single characters; also, for each merge, its cost, and the lengths then of the first and the last symbol."""
        symbols, steps = list(text), []
        while len(symbols) > 1:
            best = min(((self.cost.get(self.ids.get(a + b, -1), _NEVER), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:]))))
            if best[0] == _NEVER:
                break
            k = best[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            steps.append((best[0], len(symbols[0]), len(symbols[-1])))
        return symbols, steps

    def edge(self, i: int) -> tuple[list, list]:
        """How the left and the right end of a piece grow while it is merged: (symbol, the highest cost to get past it)."""
        if i not in self.edges:
            piece = self.pieces[i]
            symbols, steps = self.merges(piece)
            ends: tuple[list, list] = ([], [])
            for side, grown in enumerate(ends):
                now, highest = 1, 0.0
                for step in steps:
                    highest = max(highest, step[0])
                    if step[1 + side] != now:
                        grown.append((piece[:now] if side == 0 else piece[-now:], highest))
                        now, highest = step[1 + side], 0.0
                grown.append((piece, _NEVER))
            self.edges[i] = ends if len(symbols) == 1 else ([], [])
        return self.edges[i]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two pieces gives these two pieces: no merge across comes first."""
        left, right = self.edge(a)[1], self.edge(b)[0]
        i = j = 0
        while True:
            (x, past_x), (y, past_y) = left[i], right[j]
            across = self.cost.get(self.ids.get(x + y, -1), _NEVER)
            if across < past_x and across <= past_y:
                return False
            if past_x == past_y == _NEVER:
                return True
            if past_x <= past_y:
                i += 1
            else:
                j += 1

    def encode_cut(self, text: str) -> list[int]:
        """The ids of a text in which spaces are marks already."""
        last = [-1] * len(text)  # per prefix, its last token; -1: its last character is outside the model
        pairs, size = self.pairs, len(self.pieces)
        for end, (i, length) in self.find.iter(text):
            if last[end] >= 0:
                continue
            # before a token that begins the text is index -1, the end of the text, which has no token yet
            before = last[end - length]
            if before >= 0:
                pair = before * size + i
                known = pairs.item(pair % PAIR_PLACES)
                if known >> 1 != pair:
                    pairs[pair % PAIR_PLACES] = known = pair << 1 | self.compatible(before, i)
                if not known & 1:
                    continue
            last[end] = i
        ids: list[int] = []
        at = len(text) - 1
        while at >= 0:
            if (i := last[at]) >= 0:
                ids.append(i)
                at -= self.length[i]
            else:
                ids += [self.byte_ids[b] for b in reversed(text[at].encode())]
                at -= 1
        return ids[::-1]

    def encode_cuts(self, texts: list[str]) -> list[list[int]]:
        """``encode_cut`` of many texts at once."""
        out: list[list[int] | None] = [None] * len(texts)
        short = [k for k, text in enumerate(texts) if 0 < len(text) <= SHORT]
        for at in range(0, len(short), AT_ONCE):
            part = short[at : at + AT_ONCE]
            for k, ids in zip(part, self._encode_short([texts[k] for k in part]), strict=True):
                out[k] = ids
        return [self.encode_cut(text) if ids is None else ids for text, ids in zip(texts, out, strict=True)]

    def _encode_short(self, texts: list[str]) -> list[list[int] | None]:
        """None for a text with byte pieces."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        first, length, piece = self.trie.matches(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.repeat(ends, sizes))
        # by the place in a text where a match ends, the longest first
        kind = ((place[first] + length) * 64 + 63 - length).astype(np.int16)
        order = np.argsort(kind, kind="stable")
        first, piece, kind = first[order], piece[order], kind[order]
        borders = np.concatenate([[0], np.flatnonzero(np.diff(kind)) + 1, [len(kind)]]).tolist()
        last = np.full(len(place), -1)
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            if a == b:
                continue
            stop, long = int(kind[a]) // 64, 63 - int(kind[a]) % 64
            end, i = first[a:b] + (long - 1), piece[a:b]
            open_ = last[end] < 0
            if stop > long:
                before = last[first[a:b] - 1]
                inside = np.flatnonzero(open_ & (before >= 0))
                open_[inside] = self._fit(before[inside], i[inside])
            last[end[open_]] = i[open_]
        at, of, found, owner = ends - 1, np.arange(len(texts)), [], []
        starts, plain = ends - sizes, np.ones(len(texts), bool)
        while len(of):
            i = last[at]
            plain[of[i < 0]] = False
            at, of, i = at[i >= 0], of[i >= 0], i[i >= 0]
            found.append(i)
            owner.append(of)
            at = at - self.lengths[i]
            more = at >= starts[of]
            at, of = at[more], of[more]
        found, owner = np.concatenate(found[::-1]), np.concatenate(owner[::-1])
        ids = found[np.argsort(owner, kind="stable")].tolist()
        to = np.cumsum(np.bincount(owner, minlength=len(texts))).tolist()
        return [ids[a:b] if whole else None for a, b, whole in zip([0, *to], to, plain.tolist(), strict=False)]

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs."""
        pair = left * len(self.pieces) + right
        at = pair % PAIR_PLACES
        known = self.pairs[at]
        new = np.flatnonzero(known >> 1 != pair)
        if len(new):
            pairs, back = np.unique(pair[new], return_inverse=True)
            made = np.array([p << 1 | self.compatible(*divmod(p, len(self.pieces))) for p in pairs.tolist()])
            self.pairs[pairs % PAIR_PLACES] = made
            known[new] = made[back]
        return known & 1 == 1

    def decode_cut(self, ids: list[int]) -> str:
        """Pieces joined, byte pieces read as UTF-8, marks as spaces."""
        spoken = [self.spoken[i] for i in ids]
        if None not in spoken:
            return "".join(spoken)
        out, raw = [], bytearray()
        for i, piece in zip([*ids, self.end], [*spoken, ""], strict=True):
            if piece is None:
                raw.append(self.bytes_of[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace").replace(MARK, " "))
                raw.clear()
            out.append(piece)
        return "".join(out)


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """One model per worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def cuts(text: str) -> list[str]:
    """The text's parts, each beginning with its space marks; the first has the one that the model puts before a text."""
    return _CUT.findall(MARK + text.replace(" ", MARK)) if text else []


class _Cuts:
    """cut -> (ids as text, decoded) of the cuts met last. Once half of ``HELD`` are there they grow old; of the old ones those stay that are met again."""

    def __init__(self, model: PieceModel) -> None:
        self.model, self.held, self.old = model, {}, {}

    def of(self, texts: list[list[str]]) -> Iterator[list[tuple[str, str]]]:
        """What is known of the cuts of each text."""
        if len(self.held) > HELD // 2:
            self.held, self.old = {}, self.held
        held, old, new = self.held, self.old, []
        for cut in set().union(*texts):
            if cut not in held:
                if cut in old:
                    held[cut] = old[cut]
                else:
                    new.append(cut)
        for at in range(0, len(new), AT_ONCE):
            part = new[at : at + AT_ONCE]
            for cut, ids in zip(part, self.model.encode_cuts(part), strict=True):
                held[cut] = " ".join([self.model.names[i] for i in ids]), self.model.decode_cut(ids)
        for text in texts:
            yield [held[cut] for cut in text]

    def clear(self) -> None:
        self.held, self.old = {}, {}


def _grouped(texts: list[str | None]) -> Iterator[list[list[str]]]:
    """The cuts of each text, those of some texts at a time."""
    group, n = [], 0
    for text in texts:
        group.append(cuts(text or ""))
        n += len(group[-1])
        if n >= LOOKED_UP:
            yield group
            group, n = [], 0
    if group:
        yield group


def encode_text(model: PieceModel, text: str) -> list[int]:
    """All ids of a text, with the end id."""
    return [i for cut in cuts(text) for i in model.encode_cut(cut)] + [model.end]


def digest_rows(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()  # what the worker's tasks before have left
        give_back()
        model = piece_model(model_path)
        cache = _Cuts(model)
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            for made in (made for group in _grouped(batch.column(1).to_pylist()) for made in cache.of(group)):
                ids = " ".join([x[0] for x in made] + [model.names[model.end]])
                counts.append(ids.count(" ") + 1)
                ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded = "".join([x[1] for x in made])
                text_hash.append(hashlib.sha256(decoded[1:].encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        cache.clear()
        give_back()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
