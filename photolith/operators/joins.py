"""Joins that pair files, tracks, places and faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photolith.functions.geo import EARTH_M, distance_m, parse_position, project, unproject

#: Cells of circles that a task holds about.
CIRCLE_CELLS = 250_000


def classify_import(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """new, or already here by path, else by content; the lowest id of several."""
    by_path = library.groupBy("path").agg(F.min("id").alias("path_id"))
    by_hash = library.groupBy("content_hash").agg(F.min("id").alias("hash_id"))
    found = candidates.join(by_path, "path", "left").join(by_hash, "content_hash", "left")
    reason = F.when(F.col("path_id").isNotNull(), "path").when(F.col("hash_id").isNotNull(), "content").otherwise("new")
    return found.withColumn("reason", reason).withColumn("existing", F.coalesce("path_id", "hash_id")).drop("path_id", "hash_id")


def match_moved(missing: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Of equal keys the k-th missing file is the k-th found one."""
    nth = lambda df: df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("id")))
    left, right = nth(missing).withColumnRenamed("id", "missing_id"), nth(found).withColumnRenamed("id", "found_id")
    return left.join(right, [*key, "_k"]).select("missing_id", "found_id")


def folder_diff(here: DataFrame, there: DataFrame) -> DataFrame:
    """(path, content_hash) of a library and a disk -> new, missing, changed or same."""
    both = here.select("path", F.col("content_hash").alias("h1")).join(there.select("path", F.col("content_hash").alias("h2")), "path", "full")
    state = F.when(F.col("h1").isNull(), "new").when(F.col("h2").isNull(), "missing").when(F.col("h1") == F.col("h2"), "same").otherwise("changed")
    return both.select("path", state.alias("state"))


def pair_by_stem(raws: DataFrame, jpegs: DataFrame) -> DataFrame:
    """RAW and JPEG of one shot: equal folder and stem (in lower case) and camera; each JPEG is used once."""
    stem = lambda df: df.withColumn("_stem", F.regexp_replace(F.lower("file_name"), r"\.[^.]*$", ""))
    shot = ["folder", "_stem", "camera"]
    first = stem(raws).groupBy(*shot).agg(F.min("id").alias("raw_id"))  # of several RAW files the first; no pair of all is made
    return stem(jpegs).withColumnRenamed("id", "jpeg_id").join(first, shot).select("raw_id", "jpeg_id")


def as_of(points: DataFrame, track: DataFrame, key: list[str], max_gap: int) -> DataFrame:
    """Places times on a track: exact, or between two neighbours at most ``max_gap`` apart, or at the nearer within it.

    (key, id, t) and (key, t, x) -> (id, x, how). One sort of both together; windows carry the neighbours."""
    rows = points.select(*key, "id", "t", F.lit(None).cast("double").alias("x"), F.lit(1).alias("ask")).unionByName(
        track.groupBy(*key, "t").agg(F.min("x").alias("x")).select(*key, F.lit(None).cast("long").alias("id"), "t", "x", F.lit(0).alias("ask"))
    )
    place = F.when(F.col("ask") == 0, F.struct("t", "x"))
    back = Window.partitionBy(*key).orderBy("t", "ask").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*key).orderBy("t", F.desc("ask")).rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("a", F.last(place, True).over(back)).withColumn("b", F.first(place, True).over(ahead)).where("ask = 1")
    da, db = F.col("t") - F.col("a.t"), F.col("b.t") - F.col("t")
    between = F.col("a.x") + (F.col("b.x") - F.col("a.x")) * da / (F.col("b.t") - F.col("a.t"))
    how = (
        F.when(da == 0, "exact").when(db == 0, "exact").when(F.col("b.t") - F.col("a.t") <= max_gap, "between")
        .when((da <= max_gap) & (db.isNull() | (da <= db)), "before").when(db <= max_gap, "after")
    )
    x = F.when((how == "exact") & (da == 0), F.col("a.x")).when(how == "exact", F.col("b.x")).when(how == "between", between)
    x = x.when(how == "before", F.col("a.x")).when(how == "after", F.col("b.x"))
    return rows.select(*key, "id", x.alias("x"), how.alias("how"))


def utc_seconds(local_seconds: Column, zone_minutes: Column, offset_minutes: int | None = None) -> Column:
    """When a photo was taken: its clock less its recorded zone, else less ``offset_minutes``, else as it is."""
    return local_seconds - F.coalesce(zone_minutes, F.lit(offset_minutes or 0)) * 60


def locate(points: DataFrame, track: DataFrame, key: str, max_gap: float) -> DataFrame:
    """(key, id, t) and (key, t, seq, lat, lon, ele, segment) -> (key, id, lat, lon, ele, how): where a logger was.

    At a point's own time, and between two points of one segment at most ``max_gap`` seconds apart, it is interpolated (the
    short way round the globe; a height that only one point has is that one's); else the nearer point within ``max_gap``
    counts, the earlier of equally near ones; else there is no row. Of points at one time the first by ``seq`` is met from
    before and the last from behind. One sort of both together; windows carry the neighbours."""
    spot = F.struct("t", "lat", "lon", "ele", "segment")
    both = track.groupBy(key, "t").agg(F.min_by(spot, "seq").alias("first"), F.max_by(spot, "seq").alias("last"))
    kind = both.schema["first"].dataType.simpleString()
    asked = points.select(key, "id", "t", F.lit(None).cast(kind).alias("first"), F.lit(None).cast(kind).alias("last"), F.lit(1).alias("ask"))
    rows = asked.unionByName(both.select(key, F.lit(None).cast(points.schema["id"].dataType).alias("id"), "t", "first", "last", F.lit(0).alias("ask")))
    # a point at the very time stands behind the photo, so what comes before is earlier
    ordered = Window.partitionBy(key).orderBy("t", F.desc("ask"))
    rows = rows.withColumn("a", F.last("last", True).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("b", F.first("first", True).over(ordered.rowsBetween(0, Window.unboundedFollowing))).where("ask = 1")
    share = (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    turn = F.col("b.lon") - F.col("a.lon")
    turn = F.when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn)
    lon = F.col("a.lon") + turn * share
    lon = F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)
    ele = F.coalesce(F.col("a.ele") + (F.col("b.ele") - F.col("a.ele")) * share, F.col("a.ele"), F.col("b.ele"))
    lerp = F.struct((F.col("a.lat") + (F.col("b.lat") - F.col("a.lat")) * share).alias("lat"), lon.alias("lon"), ele.alias("ele"), F.lit("interpolated").alias("how"))
    at = lambda side, how: F.struct(f"{side}.lat", f"{side}.lon", f"{side}.ele", F.lit(how).alias("how"))
    before, behind = F.col("t") - F.col("a.t"), F.col("b.t") - F.col("t")
    on = F.when(behind == 0, at("b", "interpolated")).when((F.col("a.segment") == F.col("b.segment")) & (before + behind <= max_gap), lerp)
    a_near = before.isNotNull() & (behind.isNull() | (before <= behind))
    near = F.when(a_near & (before <= max_gap), at("a", "nearest")).when(~a_near & (behind <= max_gap), at("b", "nearest"))
    return rows.select(key, "id", F.coalesce(on, near).alias("p")).where("p is not null").select(key, "id", "p.lat", "p.lon", "p.ele", "p.how")


def nearest_place(photos: DataFrame, places: DataFrame, limit_m: float = 50_000.0) -> DataFrame:
    """The nearest place of each position. Places are dealt to one-degree cells; a position looks in its own and the
    eight around, across the date line; the first of equally near ones counts. Both sides are shuffled by cell. Beyond 63
    degrees of latitude a cell and the next are less than 50 km wide, so that farther places to the east or west aren't seen."""
    cell = lambda c: F.floor(c).cast("int")
    wrap = lambda c: F.pmod(c + 180, F.lit(360)) - 180
    held = places.select(F.col("place_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), cell(F.col("lat")).alias("cy"), wrap(cell(F.col("lon"))).alias("cx"))
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    asked = photos.select("id", "lat", "lon", F.explode(around).alias("o")).select(
        "id", "lat", "lon", (cell(F.col("lat")) + F.col("o.dy")).alias("cy"), wrap(cell(F.col("lon")) + F.col("o.dx")).alias("cx")
    )
    near = asked.join(held, ["cy", "cx"]).withColumn("m", distance_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))).where(F.col("m") <= limit_m)
    best = near.groupBy("id").agg(F.min_by(F.struct("place_id", "m"), F.struct("m", "place_id")).alias("best"))
    return best.select("id", "best.place_id", F.round("best.m").cast("long").alias("metres"))


PLACE_FIELDS = ("location", "city", "state", "country")


def fill_place(photos: DataFrame, nearest: DataFrame, places: DataFrame, overwrite: bool = False) -> DataFrame:
    """Photos with the fields of the place found for them (nearest: id, place_id; places: place_id and the fields).

    A field is filled where it is blank, or always with ``overwrite``; an empty field of the place changes nothing."""
    found = nearest.join(places.select("place_id", *[F.col(c).alias(f"_{c}") for c in PLACE_FIELDS]), "place_id").drop("place_id")
    blank = lambda c: F.lit(True) if overwrite else F.trim(F.coalesce(c, F.lit(""))) == ""
    filled = {c: F.when((F.col(f"_{c}") != "") & blank(c), F.col(f"_{c}")).otherwise(F.col(c)) for c in PLACE_FIELDS}
    return photos.join(found.select("id", *[f"_{c}" for c in PLACE_FIELDS]), "id", "left").withColumns(filled).select(*photos.columns)


def search_places(named: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Saved locations and place names (kind, name, lat, lon) that match, the best ``limit``: equal, then beginning with the
    query, then containing it, by name; case and blanks around don't matter. A typed position comes first, beside them."""
    wanted = query.strip().lower()
    name = F.lower(F.trim("name"))
    rank = F.when(name == wanted, 0).when(F.startswith(name, F.lit(wanted)), 1).when(F.contains(name, F.lit(wanted)), 2)
    on_earth = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & F.lit(wanted != "")
    columns = ["rank", "kind", "name", "lat", "lon"]
    best = named.withColumn("rank", rank).where(F.col("rank").isNotNull() & on_earth).orderBy("rank", "name", "kind").limit(limit).select(*columns)
    typed = named.sparkSession.range(1).select(parse_position(F.lit(wanted)).alias("p")).where("p is not null")
    typed = typed.select(F.lit(-1).alias("rank"), F.lit("position").alias("kind"), F.concat_ws(", ", "p.lat", "p.lon").alias("name"), "p.lat", "p.lon")
    return typed.unionByName(best)


def arrivals(files: DataFrame, library: DataFrame) -> DataFrame:
    """(id, path, outcome) of files in the watched folder: known, deleted (what was deleted doesn't come back by itself) or new.

    The library is reduced to a row per path first, so a file meets one row at most."""
    state = library.groupBy("path").agg(F.bool_and("deleted").alias("gone"))
    found = files.select("id", "path").join(state, "path", "left")
    outcome = F.when(F.col("gone").isNull(), "new").when(F.col("gone"), "deleted").otherwise("known")
    return found.select("id", "path", outcome.alias("outcome"))


def inside_any(photos: DataFrame, circles: DataFrame) -> DataFrame:
    """Photos (id, lat, lon) inside a saved circle (c_lat, c_lon, radius_m), the boundary included.

    A circle is dealt to the few cells it touches of a grid about as wide as itself, in degrees a power of two from 1/256
    to 256; a photo looks in its cell of each grid in use, of which there are 17 at most. Near a pole a circle touches all
    cells of its rows. An equi-join on the cell, so any number of circles is shuffled or broadcast as Spark sees fit."""
    grids = circles.select(F.degrees(F.col("radius_m") / F.lit(EARTH_M)).alias("d"))
    level = lambda d: F.greatest(F.lit(-8), F.least(F.lit(8), F.ceil(F.log2(d)).cast("int")))
    used = sorted(r[0] for r in grids.where("d > 0").select(level(F.col("d"))).distinct().collect())
    used = used or [-8]
    size = F.pow(F.lit(2.0), F.col("level"))
    across = F.greatest(F.lit(1.0), F.floor(360 / size))  # whole cells around a parallel
    column = lambda lon: F.floor((lon + 180) * across / 360).cast("long")
    reach = F.degrees(F.col("radius_m") / F.lit(EARTH_M)) * (1 + 1e-9) + 1e-9
    aside = F.when(F.abs("c_lat") + F.col("reach") >= 90, 180.0).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians("reach")) / F.cos(F.radians("c_lat"))))) + 1e-9
    )
    dealt = circles.withColumn("level", F.coalesce(level(F.degrees(F.col("radius_m") / F.lit(EARTH_M))), F.lit(used[0]))).withColumn("reach", reach)
    dealt = dealt.withColumn("aside", aside).withColumn("cy", F.explode(F.sequence(F.floor((F.col("c_lat") - F.col("reach")) / size), F.floor((F.col("c_lat") + F.col("reach")) / size))))
    columns = F.transform(F.sequence(column(F.col("c_lon") - F.col("aside")), column(F.col("c_lon") + F.col("aside"))), lambda c: F.pmod(c, across.cast("long")))
    dealt = dealt.withColumn("cx", F.explode(F.array_distinct(columns))).select("level", "cy", "cx", "c_lat", "c_lon", "radius_m")
    asked = photos.withColumn("level", F.explode(F.array(*map(F.lit, used)))).withColumn("cy", F.floor(F.col("lat") / size))
    asked = asked.withColumn("cx", F.pmod(column(F.col("lon")), across.cast("long")))
    same = (asked.level == dealt.level) & (asked.cy == dealt.cy) & (asked.cx == dealt.cx)
    hit = distance_m(asked.lat, asked.lon, dealt.c_lat, dealt.c_lon) <= dealt.radius_m
    found = asked.join(dealt, same & hit, "left_semi").drop("level", "cy", "cx")
    return found if len(used) == 1 else found.dropDuplicates(["id"])


def circle_counts(photos: DataFrame, circles: DataFrame, cell: float = 1.0) -> DataFrame:
    """(id, lat, lon) and (circle, c_lat, c_lon, radius_m) -> (circle, n): the photos inside each saved circle, none among them.

    Photos are counted by cells of ``cell`` degrees first as far as they share a place; a circle meets the cells it touches.
    Those are up to hundreds a circle, which no statistics of the circles say: they are counted, and both sides are dealt to
    so many partitions that each has about ``CIRCLE_CELLS`` of them."""
    row = lambda lat: F.floor(lat / cell)
    spots = photos.where("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.count("*").alias("n"))
    spots = spots.withColumn("cy", row(F.col("lat"))).withColumn("cx", F.pmod(F.floor((F.col("lon") + 180) / cell), F.lit(int(360 / cell))))
    reach = F.degrees(F.col("radius_m") / F.lit(EARTH_M)) * (1 + 1e-9) + 1e-9
    wide = F.when(F.abs("c_lat") + reach >= 90, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(reach)) / F.cos(F.radians("c_lat"))))) + 1e-9)
    column = lambda lon: F.floor((lon + 180) / cell)
    dealt = circles.withColumn("cy", F.explode(F.sequence(row(F.col("c_lat") - reach), row(F.col("c_lat") + reach))))
    columns = F.transform(F.sequence(column(F.col("c_lon") - wide), column(F.col("c_lon") + wide)), lambda c: F.pmod(c, F.lit(int(360 / cell))))
    dealt = dealt.withColumn("cx", F.explode(F.array_distinct(columns)))
    parts = max(int(photos.sparkSession.conf.get("spark.sql.shuffle.partitions")), dealt.count() // CIRCLE_CELLS)
    dealt, spots = (side.repartition(parts, "cy", "cx") for side in (dealt, spots))
    inside = dealt.hint("merge").join(spots, ["cy", "cx"]).where(distance_m(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")) <= F.col("radius_m"))
    counts = inside.groupBy("circle").agg(F.sum("n").alias("n"))
    return circles.select("circle").join(counts, "circle", "left").select("circle", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def map_clusters(photos: DataFrame, zoom: int, cell_px: int = 64) -> DataFrame:
    """Photos by cells of the projected map, at the mean of their projected positions."""
    x, y = project(F.col("lat"), F.col("lon"), zoom)
    size = 2 if zoom >= 16 else cell_px
    rows = photos.withColumn("x", x).withColumn("y", y)
    found = rows.groupBy(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).agg(
        F.count("*").alias("n"), F.min("id").alias("first"), F.avg("x").alias("x"), F.avg("y").alias("y")
    )
    lat, lon = unproject(F.col("x"), F.col("y"), zoom)
    return found.select("cx", "cy", "n", "first", F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"))


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two rectangles."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return F.try_divide(w * h, area(a) + area(b) - w * h)


def cooccurring(rows: DataFrame, chosen: str, limit: int) -> DataFrame:
    """Keywords of photos that also have ``chosen``: a semi-join on the photo, not a self-join of all pairs."""
    with_it = rows.where(F.col("keyword") == chosen).select("id").distinct()
    others = rows.where(F.col("keyword") != chosen).join(with_it, "id", "left_semi")
    return others.groupBy("keyword").agg(F.count_distinct("id").alias("n")).orderBy(F.desc("n"), F.lower("keyword"), "keyword").limit(limit)
