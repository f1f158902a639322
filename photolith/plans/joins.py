"""Queries that pair files, tracks, places and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith.operators import faces, joins, vectors
from photolith.plans.registry import query
from photolith.sources.photos import PHOTOS_CTE, photos, read, visible

W = f"WITH {PHOTOS_CTE} "
IN_LIBRARY = "NOT deleted AND NOT local"


@query(W + """, lib AS (SELECT * FROM photos WHERE id % 3 <> 0), p AS (SELECT path, min(id) AS pid FROM lib GROUP BY path), h AS (SELECT content_hash, min(id) AS hid FROM lib GROUP BY content_hash)
SELECT id, CASE WHEN pid IS NOT NULL THEN 'path' WHEN hid IS NOT NULL THEN 'content' ELSE 'new' END AS reason, coalesce(pid, hid) AS existing
FROM (SELECT id, content_hash, CASE WHEN id % 2 = 0 THEN regexp_replace(path, '[0-9]+$', '') || (id + 1) ELSE path END AS path FROM photos WHERE id % 3 = 0) LEFT JOIN p USING (path) LEFT JOIN h USING (content_hash)""")
def import_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_photos = photos(spark, sf_dir)
    moved = F.when(F.col("id") % 2 == 0, F.concat(F.regexp_replace("path", "[0-9]+$", ""), (F.col("id") + 1).cast("string"))).otherwise(F.col("path"))
    candidates = all_photos.where("id % 3 = 0").select("id", "content_hash", moved.alias("path"))
    return joins.classify_import(candidates, all_photos.where("id % 3 <> 0")).select("id", "reason", "existing")


@query(W + """, m AS (SELECT id, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY id) AS k FROM photos WHERE id % 2 = 0),
f AS (SELECT id, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY id) AS k FROM photos WHERE id % 2 = 1)
SELECT m.id AS missing_id, f.id AS found_id FROM m JOIN f USING (content_hash, k)""")
def moved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir).select("id", "content_hash")
    return joins.match_moved(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), ["content_hash"])


@query(W + """, a AS (SELECT path, content_hash FROM photos WHERE id % 5 <> 1), b AS (SELECT path, CASE WHEN id % 7 = 2 THEN 'x' ELSE content_hash END AS content_hash FROM photos WHERE id % 4 <> 1)
SELECT path, CASE WHEN a.content_hash IS NULL THEN 'new' WHEN b.content_hash IS NULL THEN 'missing' WHEN a.content_hash = b.content_hash THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b USING (path)""")
def folder_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir)
    disk = rows.where("id % 4 <> 1").select("path", F.when(F.col("id") % 7 == 2, "x").otherwise(F.col("content_hash")).alias("content_hash"))
    return joins.folder_diff(rows.where("id % 5 <> 1").select("path", "content_hash"), disk)


@query(W + f"SELECT id, path FROM photos WHERE {IN_LIBRARY} AND id NOT IN (SELECT page_id FROM pages)")
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_disk = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))
    return visible(photos(spark, sf_dir)).join(on_disk, "id", "left_anti").select("id", "path")


@query(W + """, r AS (SELECT id, country AS folder, camera, regexp_replace(lower(file_name), '\\.[^.]*$', '') AS stem FROM photos WHERE format = 'RAF'),
j AS (SELECT id, country AS folder, camera, regexp_replace(lower(file_name), '\\.[^.]*$', '') AS stem FROM photos WHERE format = 'JPEG')
SELECT min(r.id) AS raw_id, j.id AS jpeg_id FROM r JOIN j USING (folder, camera, stem) GROUP BY j.id""".replace("\\\\", "\\"))
def raw_jpeg_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir).select("id", F.col("country").alias("folder"), "camera", "file_name", "format")
    return joins.pair_by_stem(rows.where("format = 'RAF'").drop("format"), rows.where("format = 'JPEG'").drop("format"))


@query("""WITH track AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t, min(value) AS x FROM events WHERE event_type = 'click' GROUP BY ALL),
asked AS (SELECT user_id, event_id AS id, floor(epoch(ts))::BIGINT AS t FROM events WHERE event_type = 'error'),
near AS (SELECT a.user_id, a.id, a.t, (SELECT max(b.t) FROM track b WHERE b.user_id = a.user_id AND b.t <= a.t) AS t0, (SELECT min(b.t) FROM track b WHERE b.user_id = a.user_id AND b.t >= a.t) AS t1 FROM asked a),
placed AS (SELECT n.*, p.x AS x0, q.x AS x1 FROM near n LEFT JOIN track p ON p.user_id = n.user_id AND p.t = n.t0 LEFT JOIN track q ON q.user_id = n.user_id AND q.t = n.t1),
named AS (SELECT *, CASE WHEN t = t0 THEN 'exact' WHEN t1 - t0 <= 200000 THEN 'between' WHEN t - t0 <= 200000 AND (t1 IS NULL OR t - t0 <= t1 - t) THEN 'before' WHEN t1 - t <= 200000 THEN 'after' END AS how FROM placed)
SELECT user_id, id, how, round(CASE how WHEN 'exact' THEN x0 WHEN 'between' THEN x0 + (x1 - x0) * (t - t0) / (t1 - t0) WHEN 'before' THEN x0 WHEN 'after' THEN x1 END, 6) AS x FROM named""")
def track_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")))
    asked = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("id"), "t")
    track = events.where("event_type = 'click'").select("user_id", "t", F.col("value").alias("x"))
    return joins.as_of(asked, track, ["user_id"], 200_000).select("user_id", "id", "how", F.round("x", 6).alias("x"))


_TRACK = "SELECT user_id, floor(epoch(ts))::BIGINT AS t, event_id AS seq, value * 13 % 170 - 85 AS lat, value * 97 % 360 - 180 AS lon, CASE WHEN event_id % 3 > 0 THEN value END AS ele, floor(event_id / 700)::BIGINT AS segment FROM events WHERE event_type = 'click'"


@query(f"""WITH track AS ({_TRACK}), asked AS (SELECT user_id, event_id AS id, floor(epoch(ts))::BIGINT + 7200 - CASE WHEN event_id % 4 = 1 THEN 60 ELSE 120 END * 60 AS t FROM events WHERE event_type = 'error'),
near AS (SELECT a.*, (SELECT max(t) FROM track b WHERE b.user_id = a.user_id AND b.t < a.t) AS t0, (SELECT min(t) FROM track b WHERE b.user_id = a.user_id AND b.t >= a.t) AS t1 FROM asked a),
l AS (SELECT user_id, t, arg_max(lat, seq) AS lat, arg_max(lon, seq) AS lon, max_by({{'e': ele}}, seq).e AS ele, arg_max(segment, seq) AS segment FROM track GROUP BY ALL),
f AS (SELECT user_id, t, arg_min(lat, seq) AS lat, arg_min(lon, seq) AS lon, min_by({{'e': ele}}, seq).e AS ele, arg_min(segment, seq) AS segment FROM track GROUP BY ALL),
p AS (SELECT n.*, a.lat AS alat, a.lon AS alon, a.ele AS aele, b.lat AS blat, b.lon AS blon, b.ele AS bele, a.segment = b.segment AS same, (n.t - t0) / (t1 - t0) AS s,
CASE WHEN b.lon - a.lon > 180 THEN b.lon - a.lon - 360 WHEN b.lon - a.lon < -180 THEN b.lon - a.lon + 360 ELSE b.lon - a.lon END AS turn
FROM near n LEFT JOIN l a ON a.user_id = n.user_id AND a.t = t0 LEFT JOIN f b ON b.user_id = n.user_id AND b.t = t1),
w AS (SELECT *, CASE WHEN t = t1 THEN 'at' WHEN same AND t1 - t0 <= 200000 THEN 'on' WHEN t0 IS NOT NULL AND (t1 IS NULL OR t - t0 <= t1 - t) THEN CASE WHEN t - t0 <= 200000 THEN 'a' END WHEN t1 - t <= 200000 THEN 'b' END AS m, alon + turn * s AS x FROM p)
SELECT user_id, id, CASE WHEN m IN ('at', 'on') THEN 'interpolated' ELSE 'nearest' END AS how, round(CASE m WHEN 'on' THEN alat + (blat - alat) * s WHEN 'a' THEN alat ELSE blat END, 7) AS lat,
round(CASE m WHEN 'on' THEN CASE WHEN x > 180 THEN x - 360 WHEN x < -180 THEN x + 360 ELSE x END WHEN 'a' THEN alon ELSE blon END, 7) AS lon,
round(CASE m WHEN 'on' THEN coalesce(aele + (bele - aele) * s, aele, bele) WHEN 'a' THEN aele ELSE bele END, 6) AS ele FROM w WHERE m IS NOT NULL""")
def track_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos whose clocks say a local time, some with a recorded zone, put on each user's track."""
    events = read(spark, sf_dir, "events").withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")))
    zone = F.when(F.col("event_id") % 4 == 1, 60)
    asked = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("id"), joins.utc_seconds(F.col("t") + 7200, zone, 120).alias("t"))
    value = F.col("value")
    track = events.where("event_type = 'click'").select(
        "user_id", "t", F.col("event_id").alias("seq"), (value * 13 % 170 - 85).alias("lat"), (value * 97 % 360 - 180).alias("lon"),
        F.when(F.col("event_id") % 3 > 0, value).alias("ele"), F.floor(F.col("event_id") / 700).alias("segment"),
    )
    found = joins.locate(asked, track, "user_id", 200_000)
    return found.select("user_id", "id", "how", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.round("ele", 6).alias("ele"))


@query(W + f""", c AS (SELECT s_suppkey AS circle, (s_suppkey * 7907 % 14000)::DOUBLE / 100 - 70 AS lat, (s_suppkey * 104707 % 36000)::DOUBLE / 100 - 180 AS lon, s_suppkey % 7 * 150000.0 AS radius FROM supplier)
SELECT circle, count(p.id) AS n FROM c LEFT JOIN (SELECT id, lat, lon FROM photos WHERE {IN_LIBRARY} AND lat IS NOT NULL) p ON 2 * 6371008.8 * asin(sqrt(least(1.0, greatest(0.0,
pow(sin((radians(c.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2))))) <= radius GROUP BY circle""")
def saved_location_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many photos of the library are inside each saved location."""
    circles = read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS circle", "cast(s_suppkey * 7907 % 14000 as double) / 100 - 70 AS c_lat", "cast(s_suppkey * 104707 % 36000 as double) / 100 - 180 AS c_lon", "cast(s_suppkey % 7 * 150000.0 as double) AS radius_m"
    )
    return joins.circle_counts(visible(photos(spark, sf_dir)).select("id", "lat", "lon"), circles)


_PLACES = "places AS (SELECT p_partkey AS place_id, (p_partkey * 7907 % 14000)::DOUBLE / 100 - 70 AS lat, (p_partkey * 104707 % 36000)::DOUBLE / 100 - 180 AS lon FROM part)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS place_id", "cast(p_partkey * 7907 % 14000 as double) / 100 - 70 AS lat", "cast(p_partkey * 104707 % 36000 as double) / 100 - 180 AS lon"
    )


def _metres(a: str, b: str) -> str:
    return (
        f"2 * 6371008.8 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2)"
        f" + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))))"
    )


@query(W + f""", {_PLACES}, near AS (SELECT p.id, q.place_id, {_metres('p', 'q')} AS m FROM photos p JOIN places q
ON abs(floor(p.lat) - floor(q.lat)) <= 1 AND least((floor(p.lon) - floor(q.lon) + 360)::INT % 360, (floor(q.lon) - floor(p.lon) + 360)::INT % 360) <= 1 WHERE p.lat IS NOT NULL)
SELECT id, arg_min(place_id, (m, place_id)) AS place_id, round(min(m))::BIGINT AS metres FROM near WHERE m <= 50000 GROUP BY id""")
def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearest_place(photos(spark, sf_dir).where("lat is not null").select("id", "lat", "lon"), _places(spark, sf_dir))


_NEAR = f"""near AS (SELECT p.id, q.place_id, {_metres('p', 'q')} AS m FROM photos p JOIN places q
ON abs(floor(p.lat) - floor(q.lat)) <= 1 AND least((floor(p.lon) - floor(q.lon) + 360)::INT % 360, (floor(q.lon) - floor(p.lon) + 360)::INT % 360) <= 1 WHERE p.lat IS NOT NULL),
best AS (SELECT id, arg_min(place_id, (m, place_id)) AS place_id FROM near WHERE m <= 50000 GROUP BY id)"""
#: Fields of a place, alike in both languages.
_FIELDS = {
    "location": "CASE WHEN p_partkey % 4 = 0 THEN 'Pier' ELSE '' END", "city": "concat('Town ', cast(p_partkey % 50 as string))",
    "state": "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'North' END", "country": "concat('Land ', cast(p_partkey % 7 as string))",
}


@query(W + f""", {_PLACES}, {_NEAR}, names AS (SELECT p_partkey AS place_id, {', '.join(f'{e} AS n_{c}' for c, e in _FIELDS.items())} FROM part)
SELECT p.id, {', '.join(f"CASE WHEN n_{c} <> '' AND trim(p.{c}) = '' THEN n_{c} ELSE p.{c} END AS {c}" for c in _FIELDS)} FROM photos p LEFT JOIN best USING (id) LEFT JOIN names USING (place_id)""")
def places_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank place fields filled from the nearest place; what was typed stays."""
    every = photos(spark, sf_dir)
    nearest = joins.nearest_place(every.where("lat is not null").select("id", "lat", "lon"), _places(spark, sf_dir))
    named = read(spark, sf_dir, "part").selectExpr("p_partkey AS place_id", *[f"{e} AS {c}" for c, e in _FIELDS.items()])
    return joins.fill_place(every.select("id", *joins.PLACE_FIELDS), nearest, named)


@query(W + f""", named AS (SELECT 'location' AS kind, concat('Dock of City ', s_suppkey) AS name, (s_suppkey * 7907 % 14000)::DOUBLE / 100 - 70 AS lat, (s_suppkey * 104707 % 36000)::DOUBLE / 100 - 180 AS lon FROM supplier
UNION ALL SELECT 'place', city, avg(lat), avg(lon) FROM photos WHERE {IN_LIBRARY} AND lat IS NOT NULL AND trim(city) <> '' GROUP BY city)
SELECT rank, kind, name, round(lat, 9) AS lat, round(lon, 9) AS lon FROM (SELECT *, CASE WHEN lower(trim(name)) = 'city 1' THEN 0 WHEN starts_with(lower(trim(name)), 'city 1') THEN 1 WHEN contains(lower(name), 'city 1') THEN 2 END::INT AS rank FROM named)
WHERE rank IS NOT NULL ORDER BY rank, name, kind LIMIT 20""")
def place_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twenty of the saved locations and of the photos' cities, each with the centre of its photos."""
    saved = read(spark, sf_dir, "supplier").selectExpr(
        "'location' AS kind", "concat('Dock of City ', s_suppkey) AS name", "cast(s_suppkey * 7907 % 14000 as double) / 100 - 70 AS lat", "cast(s_suppkey * 104707 % 36000 as double) / 100 - 180 AS lon"
    )
    cities = visible(photos(spark, sf_dir)).where("lat is not null and trim(city) <> ''").groupBy("city").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    found = joins.search_places(saved.unionAll(cities.select(F.lit("place").alias("kind"), "city", "lat", "lon")), " City 1 ")
    return found.withColumns({"lat": F.round("lat", 9), "lon": F.round("lon", 9)})


@query(W + """SELECT f.id, f.path, CASE WHEN p.path IS NULL THEN 'new' WHEN p.deleted THEN 'deleted' ELSE 'known' END AS outcome
FROM (SELECT id, CASE WHEN id % 3 = 0 THEN path || '-2' ELSE path END AS path FROM photos) f LEFT JOIN (SELECT path, bool_and(deleted) AS deleted FROM photos GROUP BY path) p USING (path)""")
def watched_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a watched folder, a third of them under new names, against the library and what was deleted from it."""
    library = photos(spark, sf_dir).select("id", "path", "deleted")
    files = library.withColumn("path", F.when(F.col("id") % 3 == 0, F.concat("path", F.lit("-2"))).otherwise(F.col("path")))
    return joins.arrivals(files, library)


@query(W + f""", c AS (SELECT s_suppkey, (s_suppkey * 7907 % 14000)::DOUBLE / 100 - 70 AS lat, (s_suppkey * 104707 % 36000)::DOUBLE / 100 - 180 AS lon FROM supplier)
SELECT id FROM photos p WHERE lat IS NOT NULL AND EXISTS (SELECT 1 FROM c WHERE {_metres('p', 'c')} <= 500000)""")
def private_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    circles = read(spark, sf_dir, "supplier").selectExpr(
        "cast(s_suppkey * 7907 % 14000 as double) / 100 - 70 AS c_lat", "cast(s_suppkey * 104707 % 36000 as double) / 100 - 180 AS c_lon", "500000.0D AS radius_m"
    )
    return joins.inside_any(photos(spark, sf_dir).where("lat is not null").select("id", "lat", "lon"), circles).select("id")


@query(W + """, p AS (SELECT id, (lon + 180) / 360 * 2048 AS x, (0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 2048 AS y FROM photos WHERE lat IS NOT NULL AND NOT deleted AND NOT local)
SELECT floor(x / 64)::BIGINT AS cx, floor(y / 64)::BIGINT AS cy, count(*) AS n, min(id) AS first, round(degrees(atan(sinh(pi() * (1 - 2 * avg(y) / 2048)))), 5) AS lat, round(avg(x) / 2048 * 360 - 180, 5) AS lon FROM p GROUP BY ALL""")
def map_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.map_clusters(visible(photos(spark, sf_dir)).where("lat is not null").select("id", "lat", "lon"), 3)



@query("""SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS score FROM embeddings
WHERE list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)) >= 0.2""")
def find_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    wanted = rows.orderBy("vec_id").select("embedding").first()[0]
    return vectors.similar(rows, wanted, 0.2).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("""SELECT id, other, place, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS place FROM
(SELECT a.vec_id AS id, b.vec_id AS other, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)) WHERE place <= 10""")
def find_similar_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most alike of each twentieth vector, among all."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = vectors.top_similar(rows.where("id % 20 = 0"), rows, 10)
    return found.select("id", "other", F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"))


_RANKED = """pairs AS (SELECT u.vec_id AS id, k.label AS person, list_dot_product(u.embedding::DOUBLE[], k.embedding::DOUBLE[]) AS score FROM embeddings u, embeddings k WHERE u.vec_id % 20 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY id, person ORDER BY score DESC) AS k FROM pairs),
ranked AS (SELECT id, person, avg(score) AS score, count(*) AS n FROM top WHERE k <= 2 GROUP BY ALL)"""


def _rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    known = rows.select(F.col("label").alias("person"), "embedding")
    return vectors.rank_people(rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), "embedding"), known)


@query(f"WITH {_RANKED} SELECT id, person, round(score, 6) AS score, n FROM ranked")
def rank_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank(spark, sf_dir).select("id", "person", F.round("score", 6).alias("score"), "n")


@query(f"""WITH {_RANKED}, s AS (SELECT *, lead(score) OVER w AS nxt, row_number() OVER w AS r FROM ranked WINDOW w AS (PARTITION BY id ORDER BY score DESC, person))
SELECT id, person, round(score, 6) AS score FROM s WHERE r = 1 AND score >= 0.25 AND (nxt IS NULL OR score - nxt >= 0.01)""")
def suggest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.suggest(_rank(spark, sf_dir), 0.25, 0.01).select("id", "person", F.round("score", 6).alias("score"))


@query()
def face_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All faces in groups of likeness, every fifth marked as not being the person of its label, all together; held against
    brute force in the tests."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("person"))
    return faces.face_groups(rows, rows.where("id % 5 = 1").select("id", "person"), rows.select("person", "embedding"), 0.3, per_pass=None)


@query("""SELECT vec_id, round(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) /
((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))), 6) AS iou
FROM (SELECT vec_id, {'x0': embedding[1]::DOUBLE, 'y0': embedding[2]::DOUBLE, 'x1': embedding[1]::DOUBLE + 0.5, 'y1': embedding[2]::DOUBLE + 0.4} AS a,
{'x0': embedding[3]::DOUBLE, 'y0': embedding[4]::DOUBLE, 'x1': embedding[3]::DOUBLE + 0.3, 'y1': embedding[4]::DOUBLE + 0.6} AS b FROM embeddings)""")
def region_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.col("embedding")[k].cast("double") for k in range(4)]
    a = {"x0": e[0], "y0": e[1], "x1": e[0] + 0.5, "y1": e[1] + 0.4}
    b = {"x0": e[2], "y0": e[3], "x1": e[2] + 0.3, "y1": e[3] + 0.6}
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(joins.overlap(a, b), 6).alias("iou"))
