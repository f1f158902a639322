"""Repair of a whole catalog: tables that contradict each other are brought to hold together, and every change is listed."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolith.session import checkpointed


class Catalog(NamedTuple):
    """photos: (id, filed); albums: (id, filed, parent, folder); stacks: (id, filed); members: (stack, pos, photo), by the
    ids that stacks are filed under; counters: (kind, next). ``filed`` is the id that a record is kept under."""

    photos: DataFrame
    albums: DataFrame
    stacks: DataFrame
    members: DataFrame
    counters: DataFrame


def repair(catalog: Catalog) -> tuple[Catalog, DataFrame]:
    """The repaired catalog, and its changes (kind, id, what, n).

    In this order: every record gets the id it is filed under; a stack keeps only photos of the catalog, once each, where
    they came first, and goes if fewer than two are left; a photo in several stacks that are left stays in the first (by
    id), also if that one then goes with fewer than two; an album whose folder is missing, no folder or inside it moves to
    the top, one after the other by id, so that what hangs on an album that was moved may stay; counters pass all ids.

    Members are rows, so a stack of any size is dealt out; repeated ones are counted before the shuffle."""
    changes = []

    def refiled(rows: DataFrame, kind: str) -> DataFrame:
        changes.append(rows.where("id <> filed or id is null").select(F.lit(kind).alias("kind"), F.col("filed").alias("id"), F.lit("filed as another id").alias("what"), F.lit(1).cast("long").alias("n")))
        return rows.withColumn("id", F.col("filed"))

    photos, albums, stacks = (refiled(rows, kind) for rows, kind in ((catalog.photos, "photo"), (catalog.albums, "album"), (catalog.stacks, "stack")))
    stacks, members, of_stacks = _stacks(photos, stacks, catalog.members)
    albums, of_albums = _parents(albums)
    counters, of_counters = _counters(photos, albums, stacks, catalog.counters)
    for found in (*of_stacks, of_albums, of_counters):
        changes.append(found)
    listed = changes[0]
    for found in changes[1:]:
        listed = listed.unionAll(found)
    return Catalog(photos, albums, stacks, members, counters), listed


def _change(rows: DataFrame, kind: str, what: str, n: str) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), "id", F.lit(what).alias("what"), F.col(n).cast("long").alias("n"))


def _stacks(photos: DataFrame, stacks: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    known = photos.select(F.col("id").alias("photo"), F.lit(1).alias("_here"))
    every = members.groupBy("stack", "photo").agg(F.min("pos").alias("pos"), F.count("*").alias("copies")).join(known, "photo", "left")
    every = checkpointed(every.select("stack", "photo", "pos", "copies", F.col("_here").isNotNull().alias("here")))
    told = every.groupBy("stack").agg(F.count_if("here").alias("kept"), (F.sum("copies") - F.count_if("here")).alias("out"))
    told = checkpointed(stacks.select(F.col("id").alias("stack")).join(told, "stack", "left").na.fill(0).withColumnRenamed("stack", "id"))
    left = told.where("kept >= 2").select(F.col("id").alias("stack"))
    # of several stacks a photo stays in the first
    stay = every.where("here").join(left, "stack", "left_semi")
    stay = checkpointed(stay.groupBy("photo").agg(F.min(F.struct("stack", "pos")).alias("first"), F.count("*").alias("n")))
    kept = stay.select(F.col("first.stack").alias("stack"), F.col("first.pos").alias("pos"), "photo")
    again = left.join(kept.groupBy("stack").agg(F.count("*").alias("n")), "stack", "left").na.fill(0)
    before = told.select(F.col("id").alias("stack"), "kept")
    again = checkpointed(again.join(before, "stack").select(F.col("stack").alias("id"), "n", (F.col("kept") - F.col("n")).alias("out")))
    last = again.where("n >= 2").select(F.col("id").alias("stack"))
    changes = [
        _change(told.where("out > 0"), "stack", "missing or repeated photos left out", "out"),
        _change(told.where("kept < 2"), "stack", "fewer than two photos: removed", "kept"),
        _change(again.where("out > 0"), "stack", "photos in another stack left out", "out"),
    ]
    return stacks.join(last.withColumnRenamed("stack", "id"), "id", "left_semi"), kept.join(last, "stack", "left_semi"), changes


def _parents(albums: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Albums are put right by ascending id, and one that was moved to the top is a fine folder for those after it. So an
    album moves exactly if the way up from it breaks (a missing album, none that is a folder, a loop) and its id is below
    those of all folders on that way: else the lowest of these moves first and mends the way for it.

    The way up is followed by doubling: a row knows the lowest id among the 2^k folders above it, and where it is then."""
    folders = albums.where("folder").select(F.col("id").alias("parent"), F.lit(True).alias("_folder"))
    steps = albums.where("parent is not null").join(folders, "parent", "left")
    # up: the folder above, null once the way has ended, which broke it or not; low: the lowest folder passed
    way = steps.select("id", F.when(F.col("_folder"), F.col("parent")).alias("up"), F.when(F.col("_folder"), F.col("parent")).alias("low"), F.col("_folder").isNull().alias("broken"))
    way = checkpointed(way)
    for _ in range(albums.count().bit_length() + 1):
        if way.where("up is not null").isEmpty():
            break
        on = way.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("low").alias("next_low"), F.col("broken").alias("next_broken"))
        # a folder without a row of its own is at the top, which is a good end
        way = checkpointed(way.join(on, "up", "left").select(
            "id", F.col("next").alias("up"), F.least("low", "next_low").alias("low"), F.coalesce(F.col("broken") | F.col("next_broken"), F.col("broken")).alias("broken")
        ))
    # who still goes up after as many steps as there are albums is on a loop or below one
    moved = way.where((F.col("broken") | F.col("up").isNotNull()) & (F.col("low").isNull() | (F.col("id") <= F.col("low")))).select("id", F.lit(True).alias("_moved"))
    found = checkpointed(albums.join(moved, "id", "left"))
    top = found.withColumn("parent", F.when(F.col("_moved").isNull(), F.col("parent"))).drop("_moved")
    return top, _change(found.where("_moved"), "album", "moved to the top", "parent")


def _counters(photos: DataFrame, albums: DataFrame, stacks: DataFrame, counters: DataFrame) -> tuple[DataFrame, DataFrame]:
    past = None
    for kind, rows in (("photo", photos), ("album", albums), ("stack", stacks)):
        one = rows.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("past")).withColumn("kind", F.lit(kind))
        past = one if past is None else past.unionAll(one)
    moved = counters.join(F.broadcast(past), "kind", "left").withColumn("_next", F.greatest("next", "past"))
    change = moved.where("_next > next").select(F.lit("counter").alias("kind"), F.lit(None).cast("long").alias("id"), F.concat(F.col("kind"), F.lit(" ids passed")).alias("what"), F.col("_next").cast("long").alias("n"))
    return moved.select("kind", F.col("_next").alias("next")), change
