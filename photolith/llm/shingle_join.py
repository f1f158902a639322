"""N-gram Jaccard join with PartEnum signatures.

A document's set is its distinct 5-word shingles as 64-bit hashes. Equal sets are one class, known by a hash of the
set, so copies are never expanded. Two sets with Jaccard similarity of 0.75 or more differ in at most (|A| + |B|) / 7
elements, and the larger has at most 4/3 times the size of the smaller.

Signatures. Sizes are cut into bands [l, 4/3 l]; a set's partners are in its own band or next to it, so a set has the
signatures of its band and, where a partner can be larger than the band, those of the next. A band whose sets differ in
at most k elements cuts the feature domain into n1 first-level parts; among them are n1 - k / (k2 + 1) in which the two
differ in at most k2 elements. Each is cut into n2 second-level parts, and all subsets of n2 - k2 of them are enumerated:
in such a first-level part the two sets have the same content in one subset at least, which is the signature they share.

A subset in which a set has no element would be shared with everybody, so it isn't a signature. What this can cost is
counted: ``least`` is the number of signatures that a set must share with any partner, without those that are empty in
it. Sets for which it falls below one (small ones) are cut anew with another seed; if that fails ``SEEDS`` times, empty
subsets are signatures as well.

Signatures are bundled per pack of sets and range of signatures, as sorted 48-bit numbers with positions in the pack, so
a shuffled signature takes a few bytes, however many ranges there are. Those that occur once in their range have nothing
to say; the others go back to their packs, get their sets there and are dealt to ranges again. In each range equal
signatures are found by sorting:

* up to ``COLD`` sets share one: all their pairs are candidates, with the number of signatures they share;
* more do: it is hot. Of a hot signature no task has more rows than each packing task's first ones; the others are dealt
  to all ranges and passed through.

Candidates that share fewer signatures, hot ones of either added, than ``least`` can't be linked. The others are checked
exactly. Sets with fewer hot signatures than ``least`` share a cold one with each partner and are done. The rest meet one
leader of the hot signatures at a time, by whom large groups of near copies become one component; signatures within one
component have no more to say. What is left after ``ROUNDS`` rounds, sets made almost wholly of a frequent passage, is
compared by the rarest shingles: a prefix filter, exact as well.

Checks move each set once per block of pairs with one common set; a block is at most a few hundred sets, and a task reads
them one by one.

Nulls: a null text has no set, links with nothing and is its own component; a null id takes part, and a component's
smallest id is that of its rows that have one. Repeated rows each get a row. Empty tables give no rows. Columns besides
doc_id and text are ignored by the join and kept by ``first_of_each``. Texts of any length are taken whole; a task holds
the sets of ``HELD_SHINGLES`` shingles or of one text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photolith.llm.common import discard, give_back, materialize, partitions, table
from photolith.llm.components import connected_components
from photolith.llm.words import mix, word_hashes

N = 5
NUMERATOR, DENOMINATOR = 75, 100
COLD = 16
SEEDS = 4
ROUNDS = 4
#: A task holds so many shingles before it packs their signatures; a range of signatures holds about so many, which meet
#: so many at a time.
HELD_SHINGLES = 300_000
RANGE_SIGNATURES = 1_500_000
#: As bundled, without their sets, so many are held.
BUNDLED_SIGNATURES = 2_000_000
HELD_SIGNATURES = 250_000
#: Pairs with one common set are checked in blocks of about so many.
BLOCK = 256
#: So many rows of (text, block) are broadcast at most when sets are sent to their blocks; beyond that they are joined.
BROADCAST_ROUTES = 400_000
BROADCAST_KEYS = 2_000_000
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its n-word shingles; of all its words if there are fewer; empty without words."""
    words, first = word_hashes(texts)
    found = np.zeros(0, np.uint64)
    if len(words) >= n:
        m = len(words) - n + 1
        found = words[:m].copy()
        for k in range(1, n):
            found *= _STEP
            found += words[k : k + m]
        found = mix(found)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            own = found[a : b - n + 1]
            own.sort()
            new = own[1:] != own[:-1]
            out.append(own if new.all() else own[np.concatenate([[True], new])])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for w in words[a:b]:
                whole = whole * _STEP + w
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles))))


def differ_at_most(sizes: np.ndarray) -> np.ndarray:
    """The most elements by which two linked sets can differ, by the sum of their sizes."""
    return sizes * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def _lower_bounds() -> np.ndarray:
    """The smallest size of each band: a band reaches as far as the partners of its smallest sets do."""
    found = [1]
    while found[-1] < 1 << 40:
        found.append(found[-1] * DENOMINATOR // NUMERATOR + 1)
    return np.array(found)


LOWER = _lower_bounds()


def band(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(LOWER, sizes, side="right") - 1


def scheme(j: int) -> tuple[int, int, int]:
    """(n1, k2, n2) of a band. Parts hold several elements, so that a signature says something; beyond what k asks for,
    there are some more first-level parts, which make up for empty subsets."""
    k = int(differ_at_most(2 * (LOWER[j + 1] - 1)))
    if k <= 3:
        return 1, k, (1, 4, 6, 6)[k]
    if k < 12:
        return k // 3 + 1, 2, 5
    return k // 2 * 23 // 20 + 2, 1, 3


_SCHEMES = np.array([scheme(j) for j in range(len(LOWER) - 1)])


def shared_at_least(bands: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """How many signatures two sets share that differ in so many elements.

    In a first-level part where they differ in d second-level parts, they share the subsets without those. The fewest are
    shared if all first-level parts differ as evenly as can be: the number of such subsets is convex in d."""
    out = np.zeros(len(bands), np.int64)
    for j in np.unique(bands):
        n1, k2, n2 = map(int, _SCHEMES[j])
        subsets = np.array([comb(n2 - d, n2 - k2) if d <= n2 else 0 for d in range(n2 + 2)])
        own = bands == j
        d, more = np.divmod(differ[own], n1)
        out[own] = (n1 - more) * subsets[np.minimum(d, n2 + 1)] + more * subsets[np.minimum(d + 1, n2 + 1)]
    return out


class Signatures:
    """Signatures (found) and the entry each belongs to (owner). An entry is a set in one band: its set, band and ``least``."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        sizes = np.array([len(s) for s in sets], np.int64)
        own, reach = band(np.maximum(sizes, 1)), sizes * DENOMINATOR // NUMERATOR
        up = np.flatnonzero((sizes > 0) & (reach >= LOWER[own + 1]))
        here = np.flatnonzero(sizes > 0)
        self.set = np.concatenate([here, up])
        self.band = np.concatenate([own[here], own[up] + 1])
        largest = np.minimum(reach[self.set], LOWER[self.band + 1] - 1)
        self._agree = shared_at_least(self.band, differ_at_most(sizes[self.set] + largest))
        self.least = np.zeros(len(self.set), np.int64)
        self._found, self._owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        at = np.repeat(np.arange(len(sets)), sizes)
        todo = np.arange(len(self.set))
        for seed in range(SEEDS):
            for chosen in (todo[todo < len(here)], todo[todo >= len(here)]):
                kinds = _SCHEMES[self.band[chosen], 1] * 8 + _SCHEMES[self.band[chosen], 2]
                for kind in np.unique(kinds):
                    self._enumerate(flat, at, len(sets), chosen[kinds == kind], seed)
            todo = todo[self.least[todo] < 1]
            if not len(todo):
                break
            if seed + 1 < SEEDS:  # only these sets' elements from here on
                keep = np.zeros(len(sets), bool)
                keep[self.set[todo]] = True
                flat, at = flat[keep[at]], at[keep[at]]
        # a set that is cut anew must share one signature
        self.least = np.maximum(self.least, 1)
        self.found, self.owner = np.concatenate(self._found), np.concatenate(self._owner)

    def _enumerate(self, flat: np.ndarray, at: np.ndarray, n_sets: int, chosen: np.ndarray, seed: int) -> None:
        """The signatures of some entries, at most one a set, whose bands have one k2 and n2."""
        bands = self.band[chosen]
        n1, (_, k2, n2) = _SCHEMES[bands, 0], _SCHEMES[bands[0]]
        k2, n2 = int(k2), int(n2)
        starts = np.cumsum(n1) - n1
        entry = np.full(n_sets, -1)
        entry[self.set[chosen]] = np.arange(len(chosen))
        e = entry[at]
        if (e < 0).any():
            flat, e = flat[e >= 0], e[e >= 0]
        code = mix((bands * SEEDS + seed).astype(np.uint64) + _U(1))
        x = mix(flat ^ code[e])
        cell = ((x >> _U(32)) * n1.astype(np.uint64)[e] >> _U(32)).astype(np.int64)
        cell += starts[e]
        cell *= n2
        cell += ((x & _U(0xFFFFFFFF)) * _U(n2) >> _U(32)).astype(np.int64)
        content, filled = np.zeros(int(n1.sum()) * n2, np.uint64), np.zeros(int(n1.sum()) * n2, bool)
        np.add.at(content, cell, x * _STEP ^ x >> _U(29))
        filled[cell] = True
        content, filled = mix(content).reshape(-1, n2), filled.reshape(-1, n2)
        of = np.repeat(np.arange(len(chosen)), n1)
        part = mix(code[of] + (np.arange(len(of)) - starts[of]).astype(np.uint64) * _STEP)
        of_none = np.array([comb(n, n2 - k2) for n in range(n2 + 1)])
        empty = np.bincount(of, of_none[(~filled).sum(1)], minlength=len(chosen)).astype(np.int64)
        if seed == 0:
            self.least[chosen] = self._agree[chosen] - empty
        else:
            self.least[chosen] = np.where(self._agree[chosen] - empty > 0, 1, 0)
        last = self.least[chosen][of] < 1 if seed + 1 == SEEDS else np.zeros(len(of), bool)
        for k, subset in enumerate(combinations(range(n2), n2 - k2)):
            value, some = part + _U(k), last.copy()
            for sub in subset:
                value = value + content[:, sub] * _U(2 * sub + 3)
                some |= filled[:, sub]
            self._found.append(mix(value[some]))
            self._owner.append(chosen[of[some]])


def pack(found: np.ndarray, owner: np.ndarray, keys: np.ndarray, sizes: np.ndarray, least: np.ndarray, bands: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """Signatures by range, each range as sorted 48-bit numbers and positions in a list of its entries.

    Of a signature that more than ``COLD`` sets share here already, only the first stay in its range; the others go,
    as they are, to one of as many ranges behind the last."""
    order = np.argsort(found, kind="stable")
    found, owner = found[order], owner[order]
    of = ((found >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
    if len(found) > COLD + 1:
        more = np.zeros(len(found), bool)
        more[COLD + 1 :] = found[COLD + 1 :] == found[: -COLD - 1]
        salt = int(mix(keys[owner[:1]].astype(np.uint64))[0] % _U(ranges))
        of[more] = ranges + (of[more] + salt) % ranges
        order = np.argsort(of, kind="stable")
        found, owner, of = found[order], owner[order], of[order]
    borders = np.flatnonzero(np.diff(of)) + 1
    for a, b in zip([0, *borders], [*borders, len(of)], strict=True):
        if a == b:
            continue
        entries, place = np.unique(owner[a:b], return_inverse=True)
        yield int(of[a]), pack_entries(keys[entries], sizes[entries], least[entries], bands[entries]) + bundle(found[a:b] >> _U(16), place, len(entries))


def unpack(raw: pa.Buffer) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """(key, size, least, band) of the entries, and the signatures, sorted, with the position of each one's entry."""
    entries, at = unpack_entries(raw)
    return entries, *unbundle(raw, at)


_ENTRY = (np.int64, np.uint32, np.uint16, np.uint8)


def pack_entries(keys: np.ndarray, sizes: np.ndarray, least: np.ndarray, bands: np.ndarray) -> bytes:
    columns = (keys, sizes, np.minimum(least, 65535), bands)
    return np.array([len(keys)], np.uint32).tobytes() + b"".join(c.astype(kind).tobytes() for c, kind in zip(columns, _ENTRY, strict=True))


def unpack_entries(raw: pa.Buffer) -> tuple[tuple[np.ndarray, ...], int]:
    """What ``pack_entries`` was given, and where it ends."""
    n, at, parts = int(np.frombuffer(raw, np.uint32, 1)[0]), 4, []
    for kind in _ENTRY:
        parts.append(np.frombuffer(raw, kind, n, at))
        at += parts[-1].nbytes
    return tuple(parts), at


def bundle(found: np.ndarray, place: np.ndarray, entries: int) -> bytes:
    """Sorted 48-bit signatures with the position of each one's entry among so many."""
    high, kind = (found >> _U(32)).astype(np.int64), np.uint32 if entries > 65535 else np.uint16
    head = np.array([len(found), high[0], kind().nbytes], np.uint32).tobytes()
    steps = zlib.compress(np.diff(high, prepend=high[0]).astype(np.uint16).tobytes(), 1)
    return b"".join([head, (found & _U(0xFFFFFFFF)).astype(np.uint32).tobytes(), place.astype(kind).tobytes(), steps])


def unbundle(raw: pa.Buffer, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
    n, first, width = (int(x) for x in np.frombuffer(raw, np.uint32, 3, at))
    low = np.frombuffer(raw, np.uint32, n, at + 12)
    place = np.frombuffer(raw, np.uint32 if width == 4 else np.uint16, n, at + 12 + low.nbytes)
    found = np.frombuffer(zlib.decompress(memoryview(raw)[at + 12 + low.nbytes + place.nbytes :]), np.uint16).astype(np.uint64)
    np.cumsum(found, out=found)
    found += _U(first)
    found <<= _U(32)
    found |= low
    return found, place


def dealt(found: np.ndarray, owner: np.ndarray, entries: int, ranges: int, salt: int) -> Iterator[tuple[int, int, bytes]]:
    """(range, signatures, bundle) of a pack's signatures.

    Two of a signature stay in its range, which tells there that it is repeated; the pack's others go to one of as many
    ranges behind the last, so of a hot signature no range has more than two from each pack."""
    order = np.argsort(found, kind="stable")
    found, owner = found[order], owner[order]
    of = ((found >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
    top = found >> _U(16)
    if len(found) > 2:
        more = np.zeros(len(found), bool)
        more[2:] = top[2:] == top[:-2]
        of[more] = ranges + (of[more] + salt) % ranges
        order = np.argsort(of, kind="stable")
        top, owner, of = top[order], owner[order], of[order]
    borders = np.flatnonzero(np.diff(of)) + 1
    for a, b in zip([0, *borders], [*borders, len(of)], strict=True):
        if a < b:
            yield int(of[a]), b - a, bundle(top[a:b], owner[a:b], entries)


def repeated(bundles: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Of the signatures of each bundle of one range whether there is another of that number, about ``HELD_SIGNATURES`` looked at at a time."""
    lowest, highest = min(int(found[0]) for found, _ in bundles), max(int(found[-1]) for found, _ in bundles)
    turns = sum(len(found) for found, _ in bundles) // HELD_SIGNATURES + 1
    bounds = np.array([lowest + (highest + 1 - lowest) * t // turns for t in range(turns + 1)], np.uint64)
    cuts = [np.searchsorted(found, bounds).tolist() for found, _ in bundles]
    out = [np.zeros(len(found), bool) for found, _ in bundles]
    for t in range(turns):
        found = np.concatenate([found[c[t] : c[t + 1]] for (found, _), c in zip(bundles, cuts, strict=True)])
        order = np.argsort(found)
        same = found[order[1:]] == found[order[:-1]]
        of = np.zeros(len(found), bool)
        of[order[1:][same]] = True
        of[order[:-1][same]] = True
        at = 0
        for own, c in zip(out, cuts, strict=True):
            own[c[t] : c[t + 1]] = of[at : at + c[t + 1] - c[t]]
            at += c[t + 1] - c[t]
    return out


_FOUND = "a long, b long, shared int, least_a int, least_b int, up_a boolean, up_b boolean"


def meet(found: np.ndarray, keys: np.ndarray, sizes: np.ndarray, least: np.ndarray, bands: np.ndarray, every_hot: bool = False) -> pa.Table:
    """Of one range: candidate pairs (a < b) with the signatures they share here; for hot ones rows (a: set, b: signature, shared: 0).

    Of two sets in one band's signatures one at least belongs to the band: two that reach up from below meet there."""
    up = sizes < LOWER[bands]
    order = np.lexsort((keys, found))
    keep = np.ones(len(order), bool)
    keep[1:] = (found[order[1:]] != found[order[:-1]]) | (keys[order[1:]] != keys[order[:-1]])
    order = order[keep]
    found = found[order]
    starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(found)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in () if every_hot else np.unique(counts[(counts > 1) & (counts <= COLD)]):
        at = starts[counts == m]
        for x in range(m):
            for y in range(x + 1, m):
                p, q = order[at + x], order[at + y]
                s, t = np.minimum(sizes[p], sizes[q]).astype(np.int64), np.maximum(sizes[p], sizes[q]).astype(np.int64)
                can = (DENOMINATOR * s >= NUMERATOR * t) & ~(up[p] & up[q])
                left.append(p[can])
                right.append(q[can])
    p, q = np.concatenate(left), np.concatenate(right)
    by = np.lexsort((keys[q], keys[p]))
    p, q = p[by], q[by]
    new = np.flatnonzero(np.concatenate([[True], (keys[p[1:]] != keys[p[:-1]]) | (keys[q[1:]] != keys[q[:-1]])])) if len(p) else np.zeros(0, np.int64)
    shared = np.diff(np.append(new, len(p)))
    p, q = p[new], q[new]
    h = order if every_hot else order[np.repeat(counts > COLD, counts)]
    none = np.zeros(len(h), np.int64)
    columns = [
        np.concatenate([keys[p], keys[h]]), np.concatenate([keys[q], (found if every_hot else found[np.repeat(counts > COLD, counts)]).astype(np.int64)]),
        np.concatenate([shared, none]), np.concatenate([least[p], least[h]]), np.concatenate([least[q], none]),
        np.concatenate([up[p], up[h]]), np.concatenate([up[q], none > 0]),
    ]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "shared", "least_a", "least_b", "up_a", "up_b"])


def meet_packed(raws: list[pa.Buffer], every_hot: bool = False) -> pa.Table:
    """``meet`` over packed signatures, about ``HELD_SIGNATURES`` at a time: all rows of a signature come at once."""
    unpacked = [unpack(raw) for raw in raws]
    entries = [np.concatenate(c) for c in zip(*(u[0] for u in unpacked), strict=True)]
    offsets = np.cumsum([0, *(len(u[0][0]) for u in unpacked)])
    lowest, highest = min(int(u[1][0]) for u in unpacked), max(int(u[1][-1]) for u in unpacked)
    turns = sum(len(u[1]) for u in unpacked) // HELD_SIGNATURES + 1
    bounds = np.array([lowest + (highest + 1 - lowest) * t // turns for t in range(turns + 1)], np.uint64)
    cuts = [np.searchsorted(u[1], bounds) for u in unpacked]
    tables = []
    for t in range(turns):
        found = np.concatenate([u[1][c[t] : c[t + 1]] for u, c in zip(unpacked, cuts, strict=True)])
        of = np.concatenate([u[2][c[t] : c[t + 1]] + o for u, c, o in zip(unpacked, cuts, offsets[:-1], strict=True)])
        tables.append(meet(found, *(e[of] for e in entries), every_hot))
    every = pa.concat_tables(tables)
    if turns == 1 or every_hot:
        return every
    hot = pc.equal(every.column("shared"), 0)
    pairs = every.filter(pc.invert(hot)).group_by(["a", "b", "least_a", "least_b", "up_a", "up_b"]).aggregate([("shared", "sum")])
    pairs = pairs.rename_columns([name.removesuffix("_sum") for name in pairs.column_names])
    return pa.concat_tables([pairs.select(every.column_names).cast(every.schema), every.filter(hot)])


def document_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, key, text_hash); key is null for an empty set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1))
            keys = [set_key(s) if len(s) else None for s in sets]
            columns = [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.int64()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "key", "text_hash"])
        give_back()

    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return texts.mapInArrow(rows, "doc_id long, n_shingles long, key long, text_hash long")


_BUNDLES = "pack long, entries boolean, n long, packed binary"


def bundled_signatures(docs: DataFrame, ranges: int) -> DataFrame:
    """(text) -> (range, pack, entries, n, packed): bundles of n signatures, and of each pack once its entries.

    A pack is known by a hash of its sets, so packs with one name are equal."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def out() -> pa.RecordBatch:
            keys, sets = np.array(list(held), np.int64), list(held.values())
            s, pack = Signatures(sets), set_key(keys)
            made = [(pack % ranges, 0, pack_entries(keys[s.set], np.array([len(x) for x in sets])[s.set], s.least, s.band))]
            made += dealt(s.found, s.owner, len(s.set), ranges, pack % ranges)
            of, n, packed = zip(*made, strict=True)
            columns = [pa.array(of, pa.int32()), pa.array([pack] * len(made), pa.int64()), pa.array([k == 0 for k in n]), pa.array(n, pa.int64()), pa.array(packed, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["range", "pack", "entries", "n", "packed"])

        for batch in batches:
            for shingles in shingle_sets(batch.column(0)):
                if len(shingles) and (key := set_key(shingles)) not in held:
                    held[key] = shingles.copy()
                    size += len(shingles)
                    if size >= HELD_SHINGLES:
                        yield out()
                        held.clear()
                        size = 0
        if held:
            yield out()
            held.clear()
        give_back()

    return docs.select("text").mapInArrow(rows, f"range int, {_BUNDLES}")


def repeated_signatures(docs: DataFrame, ranges: int) -> DataFrame:
    """(text) -> (pack, entries, n, packed) without the signatures that only one set has, or a set and its copies within a pack."""

    def keep(rows: pa.Table) -> pa.Table:
        every = rows.column("range")[0].as_py() >= ranges
        kept, bundles = {}, {}
        for pack, entries, n, raw in zip(*(rows.column(k).to_pylist() for k in ("pack", "entries", "n")), rows.column("packed"), strict=True):
            if entries or every:
                kept[pack, entries] = n, raw.as_py()
            elif pack not in bundles:
                bundles[pack] = unbundle(raw.as_buffer())
        for (pack, (found, place)), again in zip(bundles.items(), repeated(list(bundles.values())) if bundles else (), strict=True):
            if again.any():
                kept[pack, False] = int(again.sum()), bundle(found[again], place[again], 65536 if place.itemsize == 4 else 0)
        bundles.clear()
        give_back()
        columns = [pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.bool_()), pa.array([v[0] for v in kept.values()], pa.int64()), pa.array([v[1] for v in kept.values()], pa.binary())]
        return pa.table(columns, ["pack", "entries", "n", "packed"])

    return bundled_signatures(docs, ranges).groupBy("range").applyInArrow(keep, _BUNDLES)


def packed_signatures(bundles: DataFrame, ranges: int) -> DataFrame:
    """(pack, entries, n, packed) -> (range, packed), of the signatures in ``bundles``."""

    def pack_again(rows: pa.Table) -> pa.Table:
        heads, made = rows.filter(rows.column("entries")).column("packed"), []
        parts = [unbundle(raw.as_buffer()) for raw in rows.filter(pc.invert(rows.column("entries"))).column("packed")]
        if parts:
            found, place = (np.concatenate(p) for p in zip(*parts, strict=True))
            made = list(pack(found << _U(16), place.astype(np.int64), *unpack_entries(heads[0].as_buffer())[0], ranges))
        give_back()
        return pa.table([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.binary())], ["range", "packed"])

    return bundles.groupBy("pack").applyInArrow(pack_again, "range int, packed binary")


def candidates(bundles: DataFrame, ranges: int) -> DataFrame:
    """(pack, entries, n, packed) -> rows of ``meet``."""

    def meet_range(rows: pa.Table) -> pa.Table:
        raws = [raw.as_buffer() for raw in rows.column("packed")]
        found = meet_packed(raws, every_hot=rows.column("range")[0].as_py() >= ranges)
        give_back()
        return found

    return packed_signatures(bundles, ranges).groupBy("range").applyInArrow(meet_range, _FOUND)


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of ``wanted`` (key, first, text_hash, ...): (text, then the columns of ``wanted``). Equal texts come once, but for rows with one id."""
    few = wanted.count() <= BROADCAST_ROUTES
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", F.xxhash64("text").alias("_hash"))
    same = (F.col("_hash") == F.col("text_hash")) & F.col("_id").eqNullSafe(F.col("first"))
    return texts.join(F.broadcast(wanted) if few else wanted, same).select("text", *wanted.columns)


def linked_pairs(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sets are linked. ``a`` is the common set of a block, and its blocks are salted."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("salt"))
    ends = F.array(F.struct(F.col("a").alias("key"), F.lit(False).alias("is_b")), F.struct(F.col("b").alias("key"), F.lit(True).alias("is_b")))
    routes = dealt.select("a", "salt", F.explode(ends).alias("end")).select("a", "salt", "end.key", "end.is_b").distinct()
    routes = materialize(routes.join(classes.select("key", "first", "text_hash"), "key"), "routes")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([s.tobytes() for s in shingle_sets(batch.column(0))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], found], ["a", "salt", "is_b", "key", "shingles"])
        give_back()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, of = None, np.zeros(0, np.uint64)
        for batch in batches:
            left, right = [], []
            a, salt, is_b, key = (batch.column(k).to_pylist() for k in range(4))
            for k, raw in enumerate(batch.column(4)):
                shingles = np.frombuffer(raw.as_buffer(), np.uint64)
                if not is_b[k]:
                    block, of = (a[k], salt[k]), shingles
                elif block == (a[k], salt[k]):
                    small, large = (of, shingles) if len(of) < len(shingles) else (shingles, of)
                    shared = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                    if DENOMINATOR * shared >= NUMERATOR * (len(of) + len(shingles) - shared):
                        left.append(a[k])
                        right.append(key[k])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
        give_back()

    sent = _sets_of(docs, routes).select("text", "a", "salt", "is_b", "key").mapInArrow(sets, "a long, salt int, is_b boolean, key long, shingles binary")
    sent = sent.repartition("a", "salt").sortWithinPartitions("a", "salt", "is_b")
    return sent.mapInArrow(check, "a long, b long").distinct()


def find_links(docs: DataFrame, n_shingles: int, classes: DataFrame) -> DataFrame:
    """(node, component) over keys of sets: the classes that links join."""
    spark = docs.sparkSession
    in_ranges = lambda n, held: int(max(partitions(spark), n // held + 1))
    bundles = materialize(repeated_signatures(docs, in_ranges(n_shingles * 5 // 4, BUNDLED_SIGNATURES)), "repeated-signatures")
    found = materialize(candidates(bundles, in_ranges(bundles.agg(F.sum("n")).first()[0] or 0, RANGE_SIGNATURES)), "candidates")
    discard(bundles)
    hot = found.where("shared = 0").select(F.col("a").alias("key"), F.col("b").alias("signature"), F.col("least_a").alias("least"), F.col("up_a").alias("up"))
    hot_of = materialize(hot.groupBy("key", "up").agg(F.count("*").alias("hot")), "hot-counts")
    of = lambda side: hot_of.select(F.col("key").alias(side), F.col("up").alias(f"up_{side}"), F.col("hot").alias(f"hot_{side}"))
    cold = found.where("shared > 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"), *[F.max(c).alias(c) for c in ("least_a", "least_b", "up_a", "up_b")])
    cold = cold.join(of("a"), ["a", "up_a"], "left").join(of("b"), ["b", "up_b"], "left")
    enough = lambda side: F.col("shared") + F.coalesce(f"hot_{side}", F.lit(0)) >= F.col(f"least_{side}")
    near = materialize(cold.where(enough("a") & enough("b")).select("a", "b"), "near-pairs")
    hot = materialize(_unresolved(hot.withColumn("component", F.col("key"))), "hot-signatures")
    discard(found)
    # one partner for each set first: most other pairs then lie within a component
    first = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first = materialize(first.unionAll(_led(hot, 0)).distinct(), "first-pairs")
    component = materialize(connected_components(materialize(linked_pairs(docs, classes, first), "first-links")), "components")
    component = _grown(docs, classes, component, _apart(near.join(first, ["a", "b"], "left_anti"), component))
    left = None
    for k in range(ROUNDS):
        named = hot.drop("component").join(component.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        hot = materialize(_unresolved(named), "hot-signatures")
        left, before = hot.count(), left
        if not left or before and left > 0.9 * before:
            break
        component = _grown(docs, classes, component, _led(hot, k + 1))
    if left:
        named = hot.drop("component").join(component.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        hot = materialize(_unresolved(named), "hot-signatures")
        component = _grown(docs, classes, component, _across(docs, classes, hot))
    return component


def _unresolved(hot: DataFrame) -> DataFrame:
    """The hot rows (key, signature, least, up, component) of sets that may be linked to one outside their component.

    Such a set shares ``least`` hot signatures with the other, and each is found in two components, one of them with a
    set of the signature's own band."""
    mixed = hot.groupBy("signature").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.min("up").alias("_up"))
    hot = hot.join(mixed.where("_low <> _high and not _up").select("signature"), "signature")
    many = hot.groupBy("key", "up").agg(F.count("*").alias("_n"), F.max("least").alias("_least")).where("_n >= _least").select("key", "up")
    return hot.join(many, ["key", "up"]).select("key", "signature", "least", "up", "component")


def _led(hot: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): of each set in hot signatures the leader that it has most of them in common with.

    A signature's leader is that set of its band which has the most hot signatures itself: among near copies the one that
    was changed least, and to which the others are closest. Later turns choose among fewer sets, others each time."""
    weight = hot.groupBy("key").agg(F.count("*").alias("weight"))
    chosen = ~F.col("up") & (F.pmod(F.xxhash64("key", F.lit(turn)), turn + 1) == 0)
    order = F.when(chosen, F.struct(-F.col("weight"), "key", "component"))
    leaders = hot.join(weight, "key").groupBy("signature").agg(F.min(order).alias("leader")).where("leader is not null")
    pairs = hot.join(leaders, "signature").where("component <> leader.component").groupBy("key", F.col("leader.key").alias("leader")).agg(F.count("*").alias("n"))
    best = pairs.groupBy("key").agg(F.max_by("leader", F.struct("n", "leader")).alias("a"))
    return best.select("a", F.col("key").alias("b"))


def _grown(docs: DataFrame, classes: DataFrame, component: DataFrame, pairs: DataFrame) -> DataFrame:
    """The components that ``component`` and the links among ``pairs`` make."""
    pairs = materialize(pairs, "pairs")
    if pairs.isEmpty():
        return component
    links = materialize(linked_pairs(docs, classes, pairs), "links")
    if links.isEmpty():
        return component
    known = component.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return materialize(connected_components(known.unionAll(links)), "components")


def _across(docs: DataFrame, classes: DataFrame, hot: DataFrame) -> DataFrame:
    """Pairs of sets with hot signatures, in different components, that can be linked: they share one of their rarest shingles.

    Of two sets that are linked each has three quarters of its shingles in the other, so with all shingles in one order,
    the rarest first, the first quarter of one and that of the other (and one more) have one in common. What a passage
    gives to many documents is left behind there. The rows of a shingle's most frequent component meet only the others.
    """
    keys = materialize(hot.select("key", "component").distinct().join(classes.select("key", "first", "text_hash"), "key"), "hot-sets")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = shingle_sets(part.column(0))
                sizes = np.array([len(f) for f in found])
                of, component = (np.repeat(part.column(k).to_numpy(), sizes) for k in (1, 2))
                shingles = np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(component, pa.int64()), pa.array(shingles, pa.int64()), pa.array(np.repeat(sizes, sizes), pa.int32())], ["key", "component", "shingle", "size"])

    every = _sets_of(docs, keys).select("text", "key", "component").mapInArrow(rows, "key long, component long, shingle long, size int").distinct()
    several_sets = every.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1")
    # a set's shingles that no other has come first in its order, so only their number matters
    ranked = every.join(several_sets, "shingle")
    w = Window.partitionBy("key")
    alone = F.col("size") - F.count("*").over(w)
    place = alone + F.row_number().over(w.orderBy("sets", "shingle"))
    last = F.col("size") - F.ceil(F.col("size") * NUMERATOR / DENOMINATOR) + 1
    kept = ranked.withColumn("place", place).where(F.col("place") <= last).select("key", "component", "shingle", "place", "size")
    kept = materialize(kept, "rare-shingles")
    most = kept.groupBy("shingle", "component").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.count("*").alias("components"))
    several = most.where("components > 1").select("shingle", "most")
    kept = kept.join(several, "shingle")
    x, y = kept.where("component <> most").alias("x"), kept.alias("y")
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.most")) | (F.col("x.key") < F.col("y.key")))
    # the first shingle that two sets share, in that order, has all the others behind it in both
    behind = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    enough = (DENOMINATOR + NUMERATOR) * (behind + 1) >= NUMERATOR * (F.col("x.size") + F.col("y.size"))
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & apart & enough)
    return pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def _apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """The pairs that aren't in one component yet."""
    of = lambda side: component.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
    found = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return found.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select(*pairs.columns)


def _joined(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, key, component, component_id); key and component are null for an empty set."""
    meta = materialize(document_sets(docs), "shingle-sets")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("head")
    classes = meta.where("key is not null").groupBy("key").agg(head).select("key", F.col("head.doc_id").alias("first"), "head.text_hash")
    classes = materialize(classes, "classes")
    component = find_links(docs, meta.agg(F.sum("n_shingles")).first()[0] or 0, classes)
    named = classes.select("key", "first").join(component.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_key = named.join(smallest, "component").select("key", "component", "component_id")
    with_set = meta.where("key is not null").join(of_key, "key").select("doc_id", "n_shingles", "key", "component", "component_id")
    none = F.lit(None).cast("long")
    return with_set.unionAll(meta.where("key is null").select("doc_id", "n_shingles", none.alias("key"), none.alias("component"), F.col("doc_id").alias("component_id")))


def join_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id)."""
    return _joined(docs).select("doc_id", "n_shingles", "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component one row, with the smallest id (null ids come last)
    and of those the smallest set key; documents without words all stay. Rows that share an id are documents of their own.

    Only the ids of rows to drop are joined to the texts; while they are few, by a count, they are broadcast, so that no
    text is shuffled. An id alone names a row only if no other row has it; the rest are known by id and set."""
    found = materialize(_joined(docs).select("doc_id", "key", "component"), "joined")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    heads = found.where("key is not null").groupBy("component").agg(F.min(order).alias("head")).select("head.doc_id", "head.key")
    heads = materialize(heads, "heads")
    known = found.where("doc_id is not null")
    several = materialize(known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "shared-ids")
    few = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids
    gone = known.where("key is not null").join(heads, ["doc_id", "key"], "left_anti").select("doc_id").distinct()
    gone = materialize(gone.join(several, "doc_id", "left_anti"), "duplicates")
    rest = docs.where("doc_id is not null").join(few(gone), "doc_id", "left_anti").select(*docs.columns)
    mixed = docs.where("doc_id is null")
    if not several.isEmpty():  # as it is in a table with a key
        mixed = mixed.unionAll(rest.join(few(several), "doc_id", "left_semi").select(*docs.columns))
        rest = rest.join(few(several), "doc_id", "left_anti").select(*docs.columns)
    mixed = mixed.withColumn("_key", _key_of("text"))
    once = mixed.where("_key is not null").dropDuplicates(["doc_id", "_key"])
    of = heads.select(F.col("doc_id").alias("_id"), F.col("key").alias("_head"))
    first = once.join(of, (F.col("_key") == F.col("_head")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return rest.unionAll(first.select(*docs.columns)).unionAll(mixed.where("_key is null").select(*docs.columns))


def _key_of(column: str) -> Column:
    @F.pandas_udf("long")
    def key(texts: pd.Series) -> pd.Series:
        return pd.Series([set_key(x) if len(x) else None for x in shingle_sets(pa.array(texts, pa.string()))], dtype="Int64")

    # else a filter on it is a second call in the same task, with a Python worker of its own, which then stays
    return key.asNondeterministic()(column)


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))
