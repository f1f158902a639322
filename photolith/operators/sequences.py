"""Runs, bursts, stacks and headers: sequence operators as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(rows: DataFrame, keys: list[str], order: list[str], gap: int, seconds: str, breaks: Column | None = None) -> DataFrame:
    """Numbers the runs in which each row is at most ``gap`` after the one before, and ``breaks`` isn't true."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(seconds).over(w)
    starts = before.isNull() | (F.col(seconds) - before > gap)
    if breaks is not None:
        starts = starts | F.coalesce(breaks, F.lit(False))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_start", starts.cast("int")).withColumn("run", F.sum("_start").over(running)).drop("_start")


def auto_stacks(photos: DataFrame, keys: list[str], gap: int = 10) -> DataFrame:
    """Runs of two or more photos: (keys, run, members in order, n)."""
    ordered = photos.withColumn("_name", F.lower("file_name"))
    found = sessions(ordered, keys, ["secs", "_name", "id"], gap, "secs")
    place = F.struct("secs", "_name", "id")
    return (
        found.groupBy(*keys, "run").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(place)), lambda x: x["id"]).alias("members"))
        .where("n >= 2")
    )


def bursts(rows: DataFrame, keys: list[str], gap: int, alike: Column) -> DataFrame:
    """Runs in which each row is also ``alike`` the one before; the best is the sharpest, the first of several."""
    found = sessions(rows, keys, ["secs", "id"], gap, "secs", ~alike)
    return found.groupBy(*keys, "run").agg(
        F.count("*").alias("n"), F.max_by("id", F.struct("sharpness", -F.col("secs"), -F.col("id"))).alias("best"), F.min("id").alias("first")
    )


def cull_plan(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keep, drop or review per row of a burst: the sharpest stays, unless several share that."""
    w = Window.partitionBy(*keys)
    top = F.max("sharpness").over(w)
    ties = F.sum((F.col("sharpness") == F.col("_top")).cast("int")).over(w)
    rows = rows.withColumn("_top", top).withColumn("_ties", ties)
    is_top = F.col("sharpness") == F.col("_top")
    decision = F.when(F.col("_top").isNull(), "review").when(is_top & (F.col("_ties") > 1), "review").when(is_top, "keep").otherwise("drop")
    return rows.withColumn("decision", decision).drop("_top", "_ties")


def header_runs(rows: DataFrame, key: str, order: list[Column], partition: list[str]) -> DataFrame:
    """Runs of equal ``key`` in list order, with their first place and length."""
    w = Window.partitionBy(*partition).orderBy(*order)
    in_key = Window.partitionBy(*partition, key).orderBy(*order)
    placed = rows.withColumn("place", F.row_number().over(w)).withColumn("_island", F.col("place") - F.row_number().over(in_key))
    return placed.groupBy(*partition, key, "_island").agg(F.min("place").alias("first"), F.count("*").alias("n")).drop("_island")


def arrange_stacks(rows: DataFrame, order: list[str], collapsed: bool) -> DataFrame:
    """Members of a stack stand together where its first stands; a collapsed stack shows its top only."""
    first = F.min(F.struct(*order)).over(Window.partitionBy("stack_id"))
    arranged = rows.withColumn("anchor", first)
    if collapsed:
        top = F.row_number().over(Window.partitionBy("stack_id").orderBy("stack_pos"))
        arranged = arranged.withColumn("_k", top).where("_k = 1").drop("_k")
    return arranged


def stacks_in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows (id, stack_id, stack_pos, collapsed, and the columns ``order``) -> with ``anchor``, where the first shown member
    of a row's stack stands, and ``stack_place``, its place within the stack; sorted by both they are in the grid's order.
    Of a collapsed stack only the first shown member is left; rows without a stack stand for themselves."""
    alone = F.when(F.col("stack_id").isNull(), F.col("id"))
    first = rows.groupBy("stack_id", alone.alias("_alone")).agg(F.min(F.struct(*order)).alias("anchor"), F.min(F.struct("stack_pos", "id")).alias("_top"))
    same = F.col("r.stack_id").eqNullSafe(F.col("f.stack_id")) & F.col("r._alone").eqNullSafe(F.col("f._alone"))
    placed = rows.withColumn("_alone", alone).alias("r").join(first.alias("f"), same)
    placed = placed.select("r.*", F.col("f.anchor").alias("anchor"), F.col("f._top").alias("_top"), F.struct("r.stack_pos", "r.id").alias("stack_place"))
    return placed.where(F.col("stack_id").isNull() | ~F.coalesce("collapsed", F.lit(False)) | (F.col("stack_place") == F.col("_top"))).drop("_alone", "_top")


def last_steps(rows: DataFrame, keys: list[str], order: list[str], keep: int = 200) -> DataFrame:
    """The last ``keep`` rows of each key by ``order``; tasks drop earlier ones before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_k", place).where(F.col("_k") <= keep).drop("_k")


def history_tail(history: Column, keep: int = 200) -> Column:
    return F.slice(history, F.greatest(F.size(history) - keep + 1, F.lit(1)), F.lit(keep))


def thin(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows per key, evenly spaced, first and last among them."""
    w = Window.partitionBy(*keys)
    placed = rows.withColumn("_k", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    step = F.floor(F.col("_k") * (most - 1) / (F.col("_n") - 1))
    before = F.floor((F.col("_k") - 1) * (most - 1) / (F.col("_n") - 1))
    return placed.where((F.col("_n") <= most) | (F.col("_k") == 0) | (step != before)).drop("_k", "_n")
