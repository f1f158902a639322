"""The change log: append-only operations, folded into the library's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decode(lines: DataFrame) -> DataFrame:
    """(value: a line of the log) -> (seq, crc, op) of undamaged records; the checksum is over the operation as written."""
    record = r'^\{"seq":(\d+),"crc":(\d+),"op":(.*)\}$'
    part = lambda k: F.regexp_extract("value", record, k)
    found = lines.select(part(1).try_cast("long").alias("seq"), part(2).try_cast("long").alias("crc"), part(3).alias("op"))
    return found.where(F.col("seq").isNotNull() & (F.crc32(F.col("op").cast("binary")) == F.col("crc")))


def after_snapshot(ops: DataFrame, seq: int) -> DataFrame:
    """Records a snapshot at ``seq`` lacks, each once."""
    return ops.where(F.col("seq") > seq).dropDuplicates(["seq"])


def fold(ops: DataFrame, upto: int | None = None) -> DataFrame:
    """Last writer wins per entity and field, as of ``upto`` (undo and redo move that); summed in each task first."""
    if upto is not None:
        ops = ops.where(F.col("seq") <= upto)
    return ops.groupBy("entity", "field").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def compact(snapshot: DataFrame, ops: DataFrame) -> DataFrame:
    """A snapshot's state with later operations: both are writers, the snapshot the earlier."""
    return snapshot.unionByName(ops.select("entity", "field", "value", "seq")).groupBy("entity", "field").agg(
        F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq")
    )


def undo(ops: DataFrame, entity: Column | str = "entity") -> DataFrame:
    """For each operation the value it replaced: what undoing it puts back (null: the field was unset)."""
    from pyspark.sql import Window

    w = Window.partitionBy("entity", "field").orderBy("seq")
    return ops.withColumn("before", F.lag("value").over(w))


def forget_plan(rows: DataFrame, used: DataFrame, now_secs: int, days: int) -> DataFrame:
    """Browsed rows that nobody needs: old enough and not referred to; the others with the reason why they stay."""
    age = F.lit(now_secs) - F.col("secs")
    found = rows.join(used.select("id").distinct().withColumn("_used", F.lit(True)), "id", "left")
    fate = F.when(F.col("_used"), "kept_used").when(age <= days * 86400, "kept_recent").when(F.col("is_edited"), "kept_edited").otherwise("forget")
    return found.withColumn("fate", fate).drop("_used")
