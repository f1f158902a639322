"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming distances, components.

A fingerprint is made of the XXH64 hashes of a text's 4-word shingles, repeats included: a bit is 1 if it is set in over
half of them. Two fingerprints are linked if they differ in at most ``BITS`` bits. Texts with one fingerprint are one
class and move no further than to its smallest id, so copies are never expanded.

1. The 64 bits are cut into m blocks. Two linked fingerprints agree in m - BITS blocks at least, so each fingerprint goes
   to one bucket for every choice of m - BITS blocks. m is at least BITS + 2, and as large as it must be for an even
   bucket to hold ``EVEN`` fingerprints at most.
2. In buckets of up to ``COLD`` fingerprints all pairs are verified, in the condition of the join.
3. A larger bucket is hot. Its members are verified against its smallest one, and linked fingerprints become components. A
   bucket within one component has no more to say. The members of the others are linked by midpoints: two fingerprints
   that differ in at most four bits are both within two bits of some third number, so each goes to the 2081 numbers
   within two bits of it, and is linked there to the smallest. At most 2081 fingerprints meet at a number, so this grows
   with the rows, not with their square, and loses no link between components.

Nulls: a null text counts as empty; texts without words have the fingerprint zero and are linked like any other. A null id
takes part, and a component's smallest id is that of its rows that have one. Repeated rows each get a row, ties go to the
smallest id. Empty tables give no rows. Columns besides doc_id and text are ignored, whatever their names. Texts are taken
whole, of any length, and their hashes ``HELD`` at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photolith.llm.common import discard, materialize, table
from photolith.llm.components import connected_components

WORDS = 4
SEED = 42
BITS = 4
EVEN = 8
COLD = 128
HELD = 50_000
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as an unsigned number; A-Z are lower-cased."""
    joined = _SPACE.sub(b" ", (text or "").encode().lower()).strip(b" ")
    if not joined:
        return 0
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.append(spaces, len(joined))
    n = max(1, len(starts) - words + 1)
    ends = ends[min(words, len(ends)) - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, HELD):
        pairs = zip(starts[at : min(n, at + HELD)].tolist(), ends[at : at + HELD].tolist(), strict=True)
        found = np.array([digest(joined[a:b], SEED) for a, b in pairs], "<u8")
        ones += np.unpackbits(found.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text) -> (doc_id, fingerprint as a signed long), a row per row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text.as_py(), words) for text in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, fingerprint long")


def block_masks(blocks: int, bits: int = BITS) -> list[int]:
    """For each choice of ``blocks - bits`` of the blocks the bits in them, as signed numbers."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    of = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [_signed(sum(chosen)) for chosen in combinations(of, blocks - bits)]


def blocks_for(n: int, bits: int = BITS) -> int:
    """How many blocks keep an even bucket of ``n`` fingerprints to ``EVEN`` at most."""
    blocks = bits + 2
    while n >> 64 * (blocks - bits) // blocks > EVEN and blocks < 16:
        blocks += 1
    return blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def link_fingerprints(prints: DataFrame, bits: int = BITS, cold: int = COLD) -> DataFrame:
    """(fingerprint), distinct -> links (a, b) with the same components as all pairs that differ in at most ``bits`` bits.

    All links are true ones, and those between fingerprints of no hot bucket are all there."""
    if bits > 4:
        raise ValueError("midpoints are two bits from each side at most")
    masks = block_masks(blocks_for(prints.count(), bits), bits)
    choices = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    placed = prints.select("fingerprint", F.explode(choices).alias("at")).select("at.choice", "at.key", "fingerprint")
    sizes = placed.groupBy("choice", "key").agg(F.count("*").alias("n"), F.min("fingerprint").alias("lead")).where("n > 1")
    sizes = materialize(sizes, "simhash-buckets")
    shared = materialize(placed.join(sizes, ["choice", "key"]), "simhash-shared")
    few = shared.where(F.col("n") <= cold).select("choice", "key", "fingerprint")
    other = few.withColumnRenamed("fingerprint", "b")
    links = few.join(other, ["choice", "key"]).where((F.col("fingerprint") < F.col("b")) & (_distance("fingerprint", "b") <= bits))
    links = links.select(F.col("fingerprint").alias("a"), "b").distinct()
    hot = shared.where(F.col("n") > cold)
    if sizes.where(F.col("n") > cold).isEmpty():
        return _written(links, sizes, shared)
    to_lead = hot.where((F.col("fingerprint") != F.col("lead")) & (_distance("fingerprint", "lead") <= bits))
    links = materialize(links.unionAll(to_lead.select(F.col("lead").alias("a"), F.col("fingerprint").alias("b")).distinct()), "simhash-near")
    of = connected_components(links).withColumnRenamed("node", "fingerprint")
    placed_in = hot.join(of, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    placed_in = materialize(placed_in.select("choice", "key", "fingerprint", "component"), "simhash-hot")
    mixed = placed_in.groupBy("choice", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    mixed = materialize(mixed.select("choice", "key"), "simhash-mixed")
    left = placed_in.join(mixed, ["choice", "key"]).select("fingerprint").distinct()
    found = _written(links.unionAll(by_midpoints(left, bits)), sizes, shared, links, placed_in, mixed)
    return found


def _written(links: DataFrame, *used: DataFrame) -> DataFrame:
    links = materialize(links, "simhash-links")
    discard(*used)
    return links


def by_midpoints(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(fingerprint), distinct -> links (a, b) that connect all that differ in at most ``bits`` bits, through numbers between."""
    flips = "transform(sequence(0, 63), i -> transform(sequence(i, 63), j -> shiftleft(1L, i) | shiftleft(1L, j)))"
    near = prints.select("fingerprint", F.explode(F.expr(f"concat(array(0L), flatten({flips}))")).alias("flip"))
    near = near.select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("middle"))
    lead = F.min("fingerprint").over(Window.partitionBy("middle"))
    stars = near.withColumn("lead", lead).where((F.col("lead") != F.col("fingerprint")) & (_distance("lead", "fingerprint") <= bits))
    if bits < 4:  # two that meet at a number can be further apart than that, so the smallest isn't enough
        other = near.withColumnRenamed("fingerprint", "lead")
        stars = near.join(other, "middle").where((F.col("lead") < F.col("fingerprint")) & (_distance("lead", "fingerprint") <= bits))
    return stars.select(F.col("lead").alias("a"), F.col("fingerprint").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, cold: int = COLD) -> DataFrame:
    """(doc_id, text) -> (doc_id, fingerprint in 16 hexadecimal digits, component_id: the smallest id that links reach)."""
    prints = materialize(fingerprints(docs, words), "simhash")
    classes = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    of = connected_components(link_fingerprints(classes.select("fingerprint"), bits, cold)).withColumnRenamed("node", "fingerprint")
    of = classes.join(of, "fingerprint", "left").select("fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component"))
    smallest = materialize(of.groupBy("component").agg(F.min("first_id").alias("component_id")), "simhash-smallest")
    of = materialize(of.join(smallest, "component").select("fingerprint", "component_id"), "simhash-components")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return prints.join(of, "fingerprint").select("doc_id", digits.alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
