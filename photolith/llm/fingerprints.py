"""Document fingerprints: a Merkle tree over sections, paragraphs and short runs of words.

A leaf is a run of words with the white space before it, cut by content: after each word whose hash is even, after
``MOST_WORDS`` words, and where a line ends. A paragraph is a line; its digest covers those of its leaves, a section's covers its paragraphs', the root the
sections'. A blank line ends a section, and so does a paragraph whose digest says so (one in four), so that an insertion
moves no later border. The leaves cover all of the text, so equal roots mean equal texts (but for collisions of 64 bits).

A fingerprint is the root, then the digest of each section with those of its paragraphs and their leaves with their
lengths, all shortened. ``likeness`` walks two trees from the root: equal branches that come in one order are shared with
all they hold, and what lies between such branches is looked at one level below, down to the leaves; it is the share of
both texts' code points in shared branches. ``differing_paths`` are the paragraphs that the walk doesn't match.

The next document in descending doc_id (a null id is the smallest) is found without a global sort in one task:
approximate quantiles of the ids cut them into as many ranges as there are shuffle partitions, and each range also gets
a copy of the first document of the range that follows. Whole texts are shuffled once, plus one per partition.

Nulls: a null text counts as empty. Rows that share an id follow each other in descending order of their texts. An
empty table gives no rows; a single document is its own next. Columns besides doc_id and text are ignored, whatever their
names. Texts are taken whole, of any length; a task holds trees of ``HELD_CHARS`` code points at once, or of two texts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith.llm.common import partitions, table
from photolith.llm.words import EXACT, bounds, hashes, mix, utf8

MOST_WORDS = 3
HELD_CHARS = 1_000_000
#: Fixed value: digits of base 64 that are plain in any text format.
_DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)
_VALUE = {chr(c): k for k, c in enumerate(_DIGITS)}
#: Leaves are known by 18 bits of their hash and by their length, which is written in full from 63 on.
_LONG = 63
_LEAF = re.compile(r"([\w-]{3})([\w-])(?:\((\d+)\))?")


class Paragraph(NamedTuple):
    digest: str
    weight: int
    leaves: list[int]  # hash and length as one number


class Section(NamedTuple):
    digest: str
    weight: int
    paragraphs: list[Paragraph]


class Tree(NamedTuple):
    root: str
    sections: list[Section]
    #: The fingerprint.
    text: str


def _digest(raw: bytes, size: int = 8) -> bytes:
    return hashlib.blake2b(raw, digest_size=size).digest()


def trees(texts: Sequence[str]) -> list[Tree]:
    """The trees of some texts, whose leaves are found all at once."""
    raw, offsets = utf8(pa.array(texts, pa.large_string()))
    starts, ends = bounds(raw, offsets)
    breaks = np.unique(np.concatenate([np.flatnonzero(raw == 10) + 1, offsets[1:]]))
    cut = mix(hashes(raw, starts, ends, EXACT)) & np.uint64(1) == 0
    at = np.arange(len(starts))
    # words since the last cut, or since a line or text began
    fresh = np.concatenate([[True], cut[:-1] | (np.diff(np.searchsorted(breaks, starts, side="right")) > 0)])[: len(at)]
    cut |= (at - np.maximum.accumulate(np.where(fresh, at, 0)) + 1) % MOST_WORDS == 0
    leaf_ends = np.unique(np.concatenate([ends[cut], breaks]))
    leaf_ends = leaf_ends[leaf_ends > 0]
    leaf_starts = np.concatenate([[0], leaf_ends[:-1]])[: len(leaf_ends)]
    codes = mix(hashes(raw, leaf_starts, leaf_ends, EXACT))
    points = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])
    lengths = points[leaf_ends] - points[leaf_starts]
    short = (codes >> np.uint64(46)).astype(np.int64)
    written = _DIGITS[np.stack([short >> 12, short >> 6 & 63, short & 63, np.minimum(lengths, _LONG)], 1)].tobytes().decode()
    packed, leaves, sizes = codes.tobytes(), (short << 40 | lengths).tolist(), np.concatenate([[0], np.cumsum(lengths)]).tolist()
    long = np.concatenate([[0], np.cumsum(lengths >= _LONG)]).tolist()

    last = np.flatnonzero((raw[leaf_ends - 1] == 10) | np.isin(leaf_ends, offsets))
    first = np.concatenate([[0], last[:-1] + 1])[: len(last)]
    text_of = np.searchsorted(offsets, leaf_starts[first], side="right") - 1
    blank = np.searchsorted(starts, leaf_ends[last]) == np.searchsorted(starts, leaf_starts[first])
    out: list[tuple[list[Section], list[bytes], list[str]]] = [([], [], []) for _ in texts]
    held: list[tuple[bytes, Paragraph, str]] = []
    for k, (of, a, b, empty) in enumerate(zip(text_of.tolist(), first.tolist(), (last + 1).tolist(), blank.tolist(), strict=True)):
        digest = _digest(packed[8 * a : 8 * b])
        code = written[4 * a : 4 * b]
        if long[b] > long[a]:
            code = "".join(code[4 * i : 4 * i + 4] + (f"({n})" if (n := int(lengths[a + i])) >= _LONG else "") for i in range(b - a))
        held.append((digest, Paragraph(digest[:4].hex(), sizes[b] - sizes[a], leaves[a:b]), code))
        if empty or digest[0] % 4 == 0 or k + 1 == len(last) or text_of[k + 1] != of:
            section = _digest(b"".join(h[0] for h in held))
            sections, digests, parts = out[of]
            digests.append(section)
            sections.append(Section(section[:4].hex(), sum(h[1].weight for h in held), [h[1] for h in held]))
            parts.append(section[:4].hex() + ":" + ",".join([h[1].digest + h[2] for h in held]))
            held = []
    found = []
    for sections, digests, parts in out:
        root = _digest(b"".join(digests), 16).hex()
        found.append(Tree(root, sections, f"{root}/{';'.join(parts)}"))
    return found


def fingerprint(text: str) -> str:
    return trees([text])[0].text


def parse(text: str) -> Tree:
    """The tree that a fingerprint describes."""
    root, _, rest = text.partition("/")
    sections = []
    for part in rest.split(";") if rest else ():
        digest, _, inner = part.partition(":")
        paragraphs = []
        for p in inner.split(","):
            leaves = []
            for code, length, whole in _LEAF.findall(p[8:]):
                number = (_VALUE[code[0]] << 6 | _VALUE[code[1]]) << 6 | _VALUE[code[2]]
                leaves.append(number << 40 | (int(whole) if whole else _VALUE[length]))
            paragraphs.append(Paragraph(p[:8], sum(_length(x) for x in leaves), leaves))
        sections.append(Section(digest, sum(p.weight for p in paragraphs), paragraphs))
    return Tree(root, sections, text)


def _length(leaf: int) -> int:
    return leaf & (1 << 40) - 1


def in_order(xs: list, ys: list) -> list[tuple[int, int]]:
    """Places of equal items, rising on both sides: those that begin and end both lists, and between them a longest rising
    chain of the items' k-th occurrences."""
    n, m = len(xs), len(ys)
    low = 0
    while low < n and low < m and xs[low] == ys[low]:
        low += 1
    high = 0
    while high < n - low and high < m - low and xs[n - 1 - high] == ys[m - 1 - high]:
        high += 1
    pairs = [(k, k) for k in range(low)]
    if low < n - high and low < m - high:
        places: dict = {}
        for j in range(m - high - 1, low - 1, -1):
            places.setdefault(ys[j], []).append(j)
        met = [(i, at.pop()) for i in range(low, n - high) if (at := places.get(xs[i]))]
        # the last items of the chains of each length, and what comes before each item
        tops: list[int] = []
        ends: list[int] = []
        before = []
        for k, (_, j) in enumerate(met):
            size = bisect_left(tops, j)
            before.append(ends[size - 1] if size else -1)
            if size == len(tops):
                tops.append(j)
                ends.append(k)
            else:
                tops[size], ends[size] = j, k
        chain, k = [], ends[-1] if ends else -1
        while k >= 0:
            chain.append(met[k])
            k = before[k]
        pairs += chain[::-1]
    return pairs + [(n - k, m - k) for k in range(high, 0, -1)]


def _gaps(pairs: list[tuple[int, int]], n: int, m: int) -> Iterator[tuple[slice, slice]]:
    """What lies between matched places, where there is something on both sides."""
    i = j = 0
    for x, y in [*pairs, (n, m)]:
        if x > i and y > j:
            yield slice(i, x), slice(j, y)
        i, j = x + 1, y + 1


def _paragraphs(sections: list[Section]) -> list[Paragraph]:
    return [p for s in sections for p in s.paragraphs]


def shared_weight(a: Tree, b: Tree) -> int:
    """Code points in branches that both trees have in one order."""
    total = 0
    pairs = in_order([s.digest for s in a.sections], [s.digest for s in b.sections])
    total += sum(a.sections[i].weight for i, _ in pairs)
    for x, y in _gaps(pairs, len(a.sections), len(b.sections)):
        p, q = _paragraphs(a.sections[x]), _paragraphs(b.sections[y])
        inner = in_order([one.digest for one in p], [one.digest for one in q])
        total += sum(p[i].weight for i, _ in inner)
        for u, v in _gaps(inner, len(p), len(q)):
            left, right = [leaf for one in p[u] for leaf in one.leaves], [leaf for one in q[v] for leaf in one.leaves]
            total += sum(_length(left[i]) for i, _ in in_order(left, right))
    return total


def tree_likeness(a: Tree, b: Tree) -> float:
    if a.root == b.root:
        return 1.0
    both = sum(s.weight for s in a.sections) + sum(s.weight for s in b.sections)
    return min(2.0 * shared_weight(a, b) / both, 1.0) if both else 0.0


def likeness(a: str, b: str) -> float:
    """1 for fingerprints with equal roots, else the share of both texts in branches that both trees have, in one order."""
    return tree_likeness(parse(a), parse(b))


def differing_paths(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of ``a`` that the walk doesn't match: unequal branches are followed down, equal ones left out."""
    x, y = parse(a), parse(b)
    if x.root == y.root:
        return []
    places = [(i, k) for i, s in enumerate(x.sections) for k in range(len(s.paragraphs))]
    pairs = in_order([s.digest for s in x.sections], [s.digest for s in y.sections])
    left = {(i, k) for i, _ in pairs for k in range(len(x.sections[i].paragraphs))}
    for u, v in _gaps(pairs, len(x.sections), len(y.sections)):
        inside = [(i, k) for i, k in places if u.start <= i < u.stop]
        p, q = _paragraphs(x.sections[u]), _paragraphs(y.sections[v])
        left |= {inside[i] for i, _ in in_order([one.digest for one in p], [one.digest for one in q])}
    return [place for place in places if place not in left]


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) dealt into ranges of descending id and sorted: (range, ahead, doc_id, text), where ahead marks the
    first document of what follows a range. Bounds and first ids are a few values per partition."""
    spark = docs.sparkSession
    n = partitions(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0]
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))[::-1]  # descending
    last = len(bounds)

    def range_of(values: pd.Series) -> np.ndarray:
        # range i holds bounds[i-1] > id >= bounds[i]; null ids stand in the last
        known = values.fillna(0).astype("int64").to_numpy()
        found = len(bounds) - np.searchsorted(bounds[::-1], known, side="right")
        return np.where(values.isna().to_numpy(), last, found)

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(range_of(values), dtype="int32")

    firsts = ids.groupBy(place("doc_id").alias("range")).agg(F.max("doc_id").alias("head"), F.count("*").alias("n")).collect()
    firsts = sorted((r["range"], r["head"]) for r in firsts)
    # the head of each range also goes to the range before it, that of the first to the last
    to_range: dict = {}
    for k, (_, head) in enumerate(firsts):
        to_range.setdefault(head, []).append(firsts[k - 1][0])

    @F.pandas_udf("array<int>")
    def places(values: pd.Series) -> pd.Series:
        own = range_of(values)
        keys = [None if missing else int(v) for v, missing in zip(values.fillna(0).astype("int64"), values.isna(), strict=True)]
        return pd.Series([[int(r), *to_range.get(key, [])] for r, key in zip(own, keys, strict=True)])

    dealt = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.posexplode(places(F.col("doc_id").cast("long"))).alias("ahead", "range"),
    )
    return dealt.repartitionById(n, F.col("range") % n).sortWithinPartitions(
        "range", F.col("ahead") > 0, F.col("doc_id").desc_nulls_last(), F.col("text").desc()
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (range, doc_id, text, tree) that waits for its next
        for batch in batches:
            told = list(zip(*(batch.column(c).to_pylist() for c in ("range", "ahead", "doc_id", "text")), strict=True))
            for part in _slices([len(row[3]) for row in told]):
                ready = []
                for (at, ahead, doc_id, text), mark in zip(told[part], trees([row[3] for row in told[part]]), strict=True):
                    if before and before[0] == at:
                        ready.append((*before[1:], text, mark))
                    before = None if ahead else (at, doc_id, text, mark)
                edits = [edit(text, following) for _, text, _, following, _ in ready]
                out = []
                for edited, own, (doc_id, text, mark, _, next_mark) in zip(edits, trees(edits), ready, strict=True):
                    digest = hashlib.sha256(edited.encode()).hexdigest()
                    out.append((doc_id, len(text), digest, mark.text, own.text, tree_likeness(mark, own), tree_likeness(mark, next_mark)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS, strict=True)], _NAMES)

    return with_next(docs).mapInArrow(
        rows,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def _slices(sizes: list[int]) -> Iterator[slice]:
    """Slices of neighbours of ``HELD_CHARS`` together, or of one."""
    at, held = 0, 0
    for k, size in enumerate(sizes):
        if k > at and held + size > HELD_CHARS:
            yield slice(at, k)
            at, held = k, 0
        held += size
    if sizes:
        yield slice(at, len(sizes))


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
