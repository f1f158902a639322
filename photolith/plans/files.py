"""Queries of the file sources and sinks: what is written to the shared folder is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith.plans.events import shared_folder
from photolith.plans.registry import query
from photolith.sources import files, metadata
from photolith.sources.photos import PHOTOS_CTE, photos, read, visible
from photolith.streaming.logs import run_stable

W = f"WITH {PHOTOS_CTE} "


@query("""SELECT list, path FROM (SELECT DISTINCT lower(p_type) AS list, lower(p_type) AS path FROM part UNION SELECT lower(p_type), lower(p_type) || '|' || string_split(p_name, ' ')[1] FROM part
UNION SELECT lower(p_type), lower(p_type) || '|' || replace(p_name, ' ', '|') FROM part)""")
def keyword_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword trees written as indented text files, and read back."""
    part = read(spark, sf_dir, "part").select(F.concat(F.lower("p_type"), F.lit("|"), F.replace("p_name", F.lit(" "), F.lit("|"))).alias("path"))
    out = f"{shared_folder(spark)}/lists"
    files.keyword_list_text(part).select(F.format_string("%s;%06d;%s", "list", F.col("place").cast("int"), "value").alias("value")).write.text(out)
    cells = F.split("value", ";", 3)
    lines = spark.read.text(out).select(cells[0].alias("list"), cells[1].cast("int").alias("place"), cells[2].alias("value"))
    return files.parse_keyword_list(lines).select("list", "path")


@query("""SELECT user_id, count(*) AS points, min(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS first, round(sum(value), 4) AS ele FROM events WHERE event_type = 'click' AND user_id % 90 - 45 <= 40 GROUP BY user_id""")
def gpx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks written as XML, a named one per user and many to a file, and read back; points off the earth are left out."""
    clicks = read(spark, sf_dir, "events").where("event_type = 'click'")
    lat = F.when(F.col("user_id") % 90 - 45 > 40, F.lit(95.0)).otherwise(F.col("user_id") % 90 - 45.0)
    point = F.format_string(
        '<trkpt lat="%s" lon="%s"><ele>%s</ele><time>%sZ</time></trkpt>', lat.cast("string"), (F.col("user_id") % 180 / 1.0).cast("string"),
        F.col("value").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
    )
    tracks = clicks.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list(point)), "").alias("points"))
    out = f"{shared_folder(spark)}/tracks"
    track = F.concat(F.lit("<trk><name>"), F.col("user_id").cast("string"), F.lit("</name><trkseg>"), "points", F.lit("</trkseg></trk>"))
    # a file is one document; it has about 250 tracks, however many there are
    named = F.pmod(F.xxhash64("user_id"), F.lit(1 + clicks.agg(F.approx_count_distinct("user_id")).first()[0] // 250))
    document = F.concat(F.lit("<gpx>"), F.array_join(F.collect_list(track), ""), F.lit("</gpx>"))
    tracks.groupBy(named.alias("file")).agg(document.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(out)
    found = files.read_gpx(spark, out)
    return found.groupBy(F.col("track").cast("long").alias("user_id")).agg(
        F.count("*").alias("points"), F.min(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss")).alias("first"), F.round(F.sum("ele"), 4).alias("ele")
    )


@query(W + "SELECT id, title, rating, label, list_filter(keywords, lambda k: trim(k) <> '') AS keywords FROM photos WHERE NOT deleted AND NOT local")
def sidecar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata packets written as text, and parsed."""
    rows = visible(photos(spark, sf_dir))
    packets = rows.select("id", metadata.write_sidecar(F.col("title"), F.col("rating"), F.col("label"), F.col("keywords")).alias("xmp"))
    parsed = packets.select("id", metadata.parse_sidecar(F.col("xmp")).alias("m"))
    return parsed.select("id", "m.title", "m.rating", "m.label", F.filter("m.subject.Bag.li", lambda k: F.trim(k) != "").alias("keywords"))


@query("SELECT p_partkey AS place_id, p_name AS name, (p_partkey * 7907 % 14000)::DOUBLE / 100 - 70 AS lat, p_size::BIGINT AS population FROM part WHERE p_partkey % 10 <> 3 AND p_partkey % 10 <> 7")
def place_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tab-separated place table, some lines of it cut short or with impossible positions."""
    lat = F.when(F.col("p_partkey") % 10 == 3, F.lit(" x ")).otherwise((F.col("p_partkey") * 7907 % 14000 / 100 - 70).cast("string"))
    cells = [F.col("p_partkey").cast("string"), F.col("p_name"), F.lit(""), F.lit(""), lat, F.lit("1.5"), F.lit(""), F.lit(""), F.lit("XX")]
    cells += [F.lit("")] * 5 + [F.col("p_size").cast("string")] + [F.lit("")] * 4
    short = F.concat_ws("\t", *cells[:6])
    line = F.when(F.col("p_partkey") % 10 == 7, short).otherwise(F.concat_ws("\t", *cells))
    out = f"{shared_folder(spark)}/places"
    read(spark, sf_dir, "part").select(line.alias("value")).write.text(out)
    return files.places(spark.read.text(out)).select("place_id", "name", F.round("lat", 6).alias("lat"), "population")


@query("""SELECT c_custkey AS path, min(scan) AS scan, any_value(size) AS size FROM (SELECT c_custkey, 1 + c_custkey % 3 AS scan, c_custkey % 5 AS size FROM customer) WHERE size > 0 GROUP BY c_custkey""")
def watch_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scans of a folder as a stream: a file is taken once its size was the same in two scans in a row."""
    scans = read(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("scan"))
    grown = F.greatest(F.lit(0), F.col("c_custkey") % 3 - F.col("scan")) + F.col("c_custkey") % 5
    base = shared_folder(spark)
    rows = scans.select(F.col("c_custkey").cast("string").alias("path"), F.col("scan").cast("long").alias("scan"), F.when(F.col("c_custkey") % 5 == 0, 0).otherwise(grown).cast("long").alias("size"))
    rows.repartition("path").write.parquet(f"{base}/scans")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/scans")
    return run_stable(stream, spark, base).select(F.col("path").cast("long").alias("path"), "scan", "size")


@query(W + "SELECT id, file_name, rating, captured, keywords FROM photos WHERE NOT deleted AND NOT local")
def library_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library as JSON lines, and read back."""
    rows = visible(photos(spark, sf_dir)).select("id", "file_name", "rating", "captured", "keywords")
    out = f"{shared_folder(spark)}/snapshot"
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(out)
    return spark.read.schema(rows.schema).json(out)
