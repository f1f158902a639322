"""Queries of the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith.functions import geo, names, temperature, times
from photolith.functions.search import stem_column, words
from photolith.functions.templates import expand, sanitize
from photolith.operators import rules
from photolith.plans.filters import _STEM
from photolith.plans.registry import query
from photolith.sources.photos import PHOTOS_CTE, photos, read

W = f"WITH {PHOTOS_CTE} "


@query(W + r"""SELECT id, list_transform(keywords, lambda k: array_to_string(list_filter(list_transform(string_split(k, '|'), lambda p: trim(p)), lambda p: p <> ''), '|')) AS cleaned,
list_transform(keywords, lambda k: array_to_string(list_concat(['moved'], string_split(k, '|')[2:]), '|')) AS moved,
len(list_distinct(list_filter(list_transform(keywords, lambda k: lower(trim(k))), lambda k: k <> '')))::BIGINT AS n FROM photos""")
def scalar_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = F.col("keywords")
    return photos(spark, sf_dir).select(
        "id", F.transform(keywords, names.clean).alias("cleaned"), F.transform(keywords, lambda k: names.reparent(k, 1, "moved")).alias("moved"),
        names.keyword_count(keywords).cast("long").alias("n"),
    )


@query(W + r"SELECT id, coalesce(captured, imported) AS date, regexp_extract(file_name, '^.+\.([^.]*)$', 1) AS extension, NOT deleted AND NOT local AS in_library, CASE WHEN swapped THEN height ELSE width END::DOUBLE AS shown_width FROM photos")
def scalar_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos(spark, sf_dir).select(
        "id", F.coalesce("captured", "imported").alias("date"), F.regexp_extract("file_name", r"^.+\.([^.]*)$", 1).alias("extension"),
        (~F.col("deleted") & ~F.col("local")).alias("in_library"), rules.shown_size()[0].alias("shown_width"),
    )


@query(W + """SELECT id, round(2 * 6371008.8 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians(51.5) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(51.5)) * pow(sin(radians(-0.12 - lon) / 2), 2))))), 3) AS metres,
round((lon + 180) / 360 * 8192, 6) AS x, round((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 8192, 6) AS y,
round(cos(radians(lat)) * (2 * pi() * 6371008.8 / 8192), 6) AS scale,
round(((lon + 500 + 180) % 360) - 180, 9) AS wrapped FROM photos WHERE lat IS NOT NULL""")
def scalar_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon")
    x, y = geo.project(lat, lon, 5)
    return photos(spark, sf_dir).where("lat is not null").select(
        "id", F.round(geo.distance_m(lat, lon, F.lit(51.5), F.lit(-0.12)), 3).alias("metres"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"),
        F.round(geo.metres_per_pixel(lat, 5), 6).alias("scale"), F.round(geo.normalize_lon(lon + 500), 9).alias("wrapped"),
    )


@query("""SELECT w AS word, count(*) AS n, first(stem) AS stem FROM (SELECT w, """ + _STEM + r""" AS stem FROM
(SELECT lower(unnest(regexp_split_to_array(text, '[^\p{L}\p{N}]+'))) AS w FROM conversations) WHERE w <> '') GROUP BY w""")
def scalar_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.explode(words(F.col("text"))).alias("word"))
    return rows.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n")).select("word", "n", stem_column(F.col("word")).alias("stem"))


@query(W + """SELECT id, dayname(captured::TIMESTAMP) AS weekday, strftime(captured::TIMESTAMP + INTERVAL 90061 SECOND, '%Y-%m-%dT%H:%M:%S') AS shifted,
epoch(captured::TIMESTAMP)::BIGINT AS secs, strftime(captured::TIMESTAMP, '%B %-d, %Y at %-I:%M:%S %p') AS shown, substr(captured, 1, 7) AS month FROM photos WHERE captured IS NOT NULL""")
def scalar_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("captured")
    return photos(spark, sf_dir).where("captured is not null").select(
        "id", times.weekday(c).alias("weekday"), times.shift_iso(c, 90061).alias("shifted"), times.iso_seconds(c).alias("secs"),
        times.display_time(c).alias("shown"), F.substring(c, 1, 7).alias("month"),
    )


_OFFSET = "CASE event_id % 8 WHEN 0 THEN '+05:30' WHEN 1 THEN '-0330' WHEN 2 THEN 'Z' WHEN 3 THEN '+2' WHEN 4 THEN ' -11:00 ' WHEN 5 THEN '+19:00' WHEN 6 THEN 'UTC' END"


@query(f"""SELECT event_id, minutes, floor(epoch(ts::TIMESTAMP))::BIGINT - 60 * coalesce(minutes, 0) AS secs FROM (SELECT event_id, ts,
CASE event_id % 8 WHEN 0 THEN 330 WHEN 1 THEN -210 WHEN 2 THEN 0 WHEN 3 THEN 120 WHEN 4 THEN -660 END::INT AS minutes FROM events)""")
def scalar_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera times with their offsets from UTC."""
    local = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy:MM:dd HH:mm:ss")
    rows = read(spark, sf_dir, "events").select("event_id", local.alias("text"), F.expr(_OFFSET).alias("offset"))
    return rows.select("event_id", times.offset_minutes(F.col("offset")).alias("minutes"), times.utc_seconds(F.col("text"), F.col("offset")).alias("secs"))


@query(W + r"""SELECT id, replace(replace(regexp_replace(file_name, '\.[^.]*$', '') || '_' || coalesce(substr(captured, 1, 4), '') || '_' || rating || '_' || camera || '.' || lower(regexp_extract(file_name, '^.+\.([^.]*)$', 1)), ' ', '-'), ':', '-') AS new_name FROM photos""")
def scalar_rename_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = expand("{name}_{year}_{rating}_{camera}.{ext}")
    return photos(spark, sf_dir).select("id", F.replace(sanitize(name), F.lit(" "), F.lit("-")).alias("new_name"))


@query("""SELECT vec_id, round(v / 12.92, 9) AS low, round(CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END, 9) AS linear FROM
(SELECT vec_id, abs(embedding[1]::DOUBLE) AS v FROM embeddings)""")
def scalar_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sRGB decoding of a value."""
    v = F.abs(F.col("embedding")[0].cast("double"))
    linear = F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(v / 12.92, 9).alias("low"), F.round(linear, 9).alias("linear"))


_KIM = "CASE WHEN k <= 4000 THEN -0.2661239e9 / k ** 3 - 0.2343589e6 / k ** 2 + 0.8776956e3 / k + 0.179910 ELSE -3.0258469e9 / k ** 3 + 2.1070379e6 / k ** 2 + 0.2226347e3 / k + 0.240390 END"
_KIM_Y = "CASE WHEN k <= 2222 THEN -1.1063814 * x ** 3 - 1.34811020 * x ** 2 + 2.18555832 * x - 0.20219683 WHEN k <= 4000 THEN -0.9549476 * x ** 3 - 1.37418593 * x ** 2 + 2.09137015 * x - 0.16748867 ELSE 3.0817580 * x ** 3 - 5.87338670 * x ** 2 + 3.75112997 * x - 0.37001483 END"


@query(f"""WITH g AS (SELECT p_partkey, 2000.0 + p_partkey % 220 * 100 AS k0, p_partkey % 61 - 30 AS tint FROM part), m AS (SELECT *, unnest([0, 1, -1]) AS d FROM g), x AS (SELECT *, {_KIM} AS x FROM (SELECT *, 1e6 / (1e6 / k0 + d) AS k FROM m)),
uv AS (SELECT *, 4 * x / (-2 * x + 12 * y + 3) AS u, 6 * y / (-2 * x + 12 * y + 3) AS v FROM (SELECT *, {_KIM_Y} AS y FROM x)),
p AS (SELECT p_partkey, k0, tint, max(u) FILTER (d = 0) AS u, max(v) FILTER (d = 0) AS v, max(u) FILTER (d = -1) - max(u) FILTER (d = 1) AS du, max(v) FILTER (d = -1) - max(v) FILTER (d = 1) AS dv FROM uv GROUP BY ALL),
n AS (SELECT *, u + -dv / sqrt(du * du + dv * dv) * sign(du) * tint / 3000 AS a, v + du / sqrt(du * du + dv * dv) * sign(du) * tint / 3000 AS b FROM p)
SELECT p_partkey AS id, round(3 * a / (2 * a - 8 * b + 4), 9) AS x, round(2 * b / (2 * a - 8 * b + 4), 9) AS y, k0::DOUBLE AS kelvin, tint::DOUBLE AS tint FROM n""")
def colour_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The light that a temperature and a tint correct, and both found again from it."""
    key = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(key.alias("id"), (2000.0 + key % 220 * 100).alias("kelvin"), (key % 61 - 30).cast("double").alias("tint"))
    told = rows.withColumn("p", temperature.temperature_to_xy(F.col("kelvin"), F.col("tint")))
    found = told.withColumn("f", temperature.xy_to_temperature(F.col("p.x"), F.col("p.y")))
    # as near as the locus's bends let the nearest temperature be
    near = lambda got, want, apart: F.when(F.abs(got - want) <= apart, want).otherwise(got)
    # as SQL rounds, from the number itself; F.round goes by its shortest decimals, which can end in a 5 that isn't quite there
    rounded = lambda c: F.round(F.col(c) * 1e9) / 1e9
    return found.select(
        "id", rounded("p.x").alias("x"), rounded("p.y").alias("y"),
        near(F.col("f.kelvin"), F.col("kelvin"), F.col("kelvin") * 0.01).alias("kelvin"), near(F.col("f.tint"), F.col("tint"), F.lit(1.0)).alias("tint"),
    )


@query(W + "SELECT id, round(round(lat, 2) * 10000)::BIGINT AS qlat, md5(content_hash || file_size) AS fingerprint FROM photos WHERE lat IS NOT NULL")
def scalar_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos(spark, sf_dir).where("lat is not null").select(
        "id", F.round(F.round("lat", 2) * 10000).cast("long").alias("qlat"), F.md5(F.concat("content_hash", F.col("file_size").cast("string")).cast("binary")).alias("fingerprint")
    )
