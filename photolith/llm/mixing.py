"""Mixing sources to target weights: hash-random order, distributed prefix sums, an exact cut per source.

Within a source the documents stand in the order of a hash of their id, which is as good as random and the
same in every run. The first hex digits of that hash split a source into many even buckets, so the running sum of
sizes needs no task that holds a whole source: bucket totals are summed first, their prefix sums are taken over the
small table of totals, and each bucket adds its offset to its own running sum.

Nulls: a null text has size 0; a null source is a source of its own, the last; a null id is hashed as ''.
Repeated rows are documents of their own. An empty table gives no rows; a source without words has target 0.
Columns besides doc_id, text and source are ignored, whatever their names. Texts are taken whole, of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photolith.llm.common import WORD, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target: ``share`` of all sizes split by weight, none above ``most`` times its size.

    Resharing the excess until none is above a cap ends where every source has min(cap, level * weight). Sources
    are taken by cap per weight: one is capped if the level that fills all before it reaches its own cap. The
    windows here run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(0))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    return (
        totals.withColumn("rank", F.row_number().over(by_name))
        .withColumn("w", w.cast("double"))
        .withColumn("cap", F.col("source_size").cast("double") * most)
        .withColumn("budget", F.sum("source_size").over(all_rows).cast("double") * share)
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("capped", F.col("cap") * F.col("w_left") <= (F.col("budget") - F.col("cap_before")) * F.col("w"))
        .withColumn("open_w", F.sum(F.when(~F.col("capped"), F.col("w")).otherwise(0.0)).over(all_rows))
        .withColumn("filled", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(all_rows))
        .withColumn(
            "target",
            F.when(F.col("capped"), F.col("cap")).otherwise((F.col("budget") - F.col("filled")) * F.col("w") / F.col("open_w")),
        )
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, keep: tuple[str, ...] = (), seed: str = SEED) -> DataFrame:
    """(doc_id, text, source) -> (doc_id, size, source_size, target, taken, *keep): words that the mix takes of each row.

    A target of one or more whole epochs takes every document so often; the rest is cut from the hash order at
    exactly that many words, so the last document may be taken in part.
    """
    rank_key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)).cast("binary"))
    sized = docs.select(
        "doc_id", "source", *keep, word_count(F.col("text")).alias("size"), rank_key.alias("_key"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_src"),
    ).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    buckets = sized.groupBy("_src", "_bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size"))
    whole = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(whole).withColumn("_src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    up_to = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        buckets.withColumn("_offset", F.coalesce(F.sum("bucket_size").over(up_to), F.lit(0)))
        .join(targets, "_src")
        .select("_src", "_bucket", "_offset", "source_size", "target")
    )
    running = Window.partitionBy("_src", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor("target") - F.col("_epochs") * F.col("source_size")
    return (
        sized.drop("source")
        .join(offsets, ["_src", "_bucket"])
        .withColumn("_before", F.col("_offset") + F.coalesce(F.sum("size").over(running), F.lit(0)))
        .withColumn("_epochs", epochs.cast("long"))
        .withColumn("taken", F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before"))))
        .select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), *keep)
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as the mix takes it whole, and the one at
    a source's cut with its taken words only (n_chars, if there, follows)."""
    row = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row"))
    taken = mix(row, keep=("_row",))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = F.col("taken") - times * F.col("size")
    parts = F.concat(F.array_repeat(F.col("size"), times), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    copies = taken.select("_row", "size", F.explode(parts).alias("_words"))
    pieces = F.regexp_extract_all(F.col("_row.text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.col("_words") < F.col("size")
    text = F.when(cut, F.array_join(F.slice(pieces, F.lit(1), F.col("_words").cast("int")), "")).otherwise(F.col("_row.text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return copies.select(*[changed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}') AS key
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][((rank - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size::DOUBLE * 2 AS cap,
         (sum(source_size) OVER ())::DOUBLE * 1.5 AS budget
  FROM totals
), filled AS (
  SELECT *, coalesce(sum(cap) OVER b, 0) AS cap_before, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_left
  FROM weighed
  WINDOW b AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
  SELECT *, cap * w_left <= (budget - cap_before) * w AS is_capped FROM filled
), targets AS (
  SELECT source, source_size,
         CASE WHEN is_capped THEN cap
              ELSE (budget - sum(CASE WHEN is_capped THEN cap ELSE 0 END) OVER ()) * w
                   / sum(CASE WHEN is_capped THEN 0 ELSE w END) OVER () END AS target
  FROM capped
), running AS (
  SELECT doc_id, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken
FROM running
"""
