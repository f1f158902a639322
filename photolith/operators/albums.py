"""Albums: their photos in hand order, their own order among siblings, what a source shows, and copied metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photolith.operators.filters import Filter, apply
from photolith.session import checkpointed

#: The fields that are copied from one photo to others.
COPIED = ["rating", "label", "title", "caption", "alt_text", "extended_description", "copyright", "copyright_status", "usage_terms", "copyright_url", "creator", "location", "city", "state", "country", "keywords"]


def hand_order(photos: DataFrame, members: DataFrame, album: int, ascending: bool = True) -> tuple[DataFrame, list[Column]]:
    """The photos of one album and the keys that put them in its hand order; both feed ``catalog.page``.

    ``members`` is (album, id, place). The filter on the album reaches the scan; a page is merged from each task's first rows."""
    found = apply(photos, Filter()).join(members.where(F.col("album") == album).select("id", "place"), "id")
    return found, [F.asc(c) if ascending else F.desc(c) for c in ("place", "id")]


def sibling_keys() -> list[Column]:
    """Folders first, then albums with a place of their own by it, then the others by name."""
    return [F.desc("folder"), F.col("place").isNull().asc(), F.col("place").asc(), F.lower("name").asc(), F.col("id").asc()]


def siblings(albums: DataFrame) -> DataFrame:
    """(id, parent, name, folder, place) -> and ``listed``, the position among the albums of one folder."""
    return albums.withColumn("listed", F.row_number().over(Window.partitionBy("parent").orderBy(*sibling_keys())))


def sort_by_name(albums: DataFrame, parent: int | None) -> DataFrame:
    """The albums of one folder (None: the top level) lose the places given by hand; ``changed`` marks those that had one."""
    lost = F.col("parent").eqNullSafe(F.lit(parent)) & F.col("place").isNotNull()
    return albums.withColumn("changed", lost).withColumn("place", F.when(~lost, F.col("place")))


def source_filter(source: str, members: DataFrame | None = None) -> Filter:
    """The filter of a source; for an album (album, id) rows of it. Recently added photos come from ``recently_added``."""
    made = {"all": Filter(), "deleted": Filter(deleted=True), "picks": Filter(flag="pick"), "album": Filter(album=members)}
    return made[source]


def source_totals(photos: DataFrame, members: DataFrame, days: int = 30) -> DataFrame:
    """(source, album, n): the photos that each source shows before the filter bar, each album a source of its own.

    One pass: photos and the albums they are in meet by id, each photo counts once for all sources and once per album, by
    its day of import. What is left is a row per day and per album; the latest day is found there."""
    told = photos.select("id", ~F.col("deleted") & ~F.col("local"), F.col("deleted"), F.col("flag") == "pick", F.substring("imported", 1, 10)).toDF("id", "shown", "gone", "pick", "day")
    rows = told.withColumn("album", F.lit(None).cast("long")).unionByName(members.select("id", F.col("album").cast("long").alias("album")), allowMissingColumns=True)
    one = rows.groupBy("id").agg(
        F.collect_set("album").alias("albums"), F.count_if(F.col("shown").isNotNull()).alias("copies"), F.count_if("shown").alias("shown"),
        F.count_if("gone").alias("gone"), F.count_if(F.col("shown") & F.col("pick")).alias("picks"), F.max("day").alias("day"),
    ).where("copies > 0")
    each = one.select("shown", "gone", "picks", "day", F.explode(F.concat(F.array(F.lit(None).cast("long")), "albums")).alias("album"))
    by_day = F.when(F.col("album").isNull(), F.col("day"))
    sums = checkpointed(each.groupBy("album", by_day.alias("day")).agg(F.sum("shown").alias("shown"), F.sum("gone").alias("gone"), F.sum("picks").alias("picks")))
    plain = sums.where("album is null")
    latest = plain.where("shown > 0").agg(F.date_sub(F.to_date(F.max("day")), days).cast("string")).scalar()
    plain = plain.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("shown", "gone", "picks", F.when(F.col("day") >= latest, F.col("shown")))]).toDF("all", "deleted", "picks", "recent")
    plain = plain.select(F.inline(F.array(*[F.struct(F.lit(c).alias("source"), F.lit(None).cast("long").alias("album"), F.col(c).alias("n")) for c in plain.columns])))
    return plain.unionAll(sums.where("album is not null and shown > 0").select(F.lit("album").alias("source"), "album", F.col("shown").alias("n")))


def paste_metadata(photos: DataFrame, source_id: int, targets: Column, fields: list[str] | None = None) -> DataFrame:
    """The targets with the chosen fields (all that are copied, if None) of one photo, whose row is read once and goes along as literals."""
    chosen = [f for f in COPIED if fields is None or f in fields]
    copied = photos.where(F.col("id") == source_id).select(*chosen).first()
    if copied is None:
        return photos
    kinds = photos.schema
    literal = lambda f: (F.array(*map(F.lit, copied[f])) if isinstance(copied[f], list) else F.lit(copied[f])).cast(kinds[f].dataType)
    return photos.withColumns({f: F.when(targets, literal(f)).otherwise(F.col(f)) for f in chosen})
