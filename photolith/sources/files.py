"""File sources: folder listings, formats by magic bytes, place tables, tracks, keyword lists, SQLite catalogs."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Formats and the hex digits that their files begin with ('.' is any digit).
MAGIC = [
    ("jpeg", "FFD8FF"),
    ("png", "89504E470D0A1A0A"),
    ("gif", "47494638"),
    ("bmp", "424D"),
    ("psd", "38425053"),
    ("tiff", "49492A00"),
    ("tiff", "4D4D002A"),
    ("webp", "52494646........57454250"),
    ("avif", "........6674797061766966"),
    ("heif", "........66747970(68656963|68656978|6D696631)"),
    ("jxl", "FF0A"),
    ("jxl", "0000000C4A584C20"),
    ("raf", "46554A4946494C4D"),
]
EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "psd", "tif", "tiff", "webp", "avif", "heic", "heif", "jxl", "raf", "dng", "cr3", "nef", "arw")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, size) of all files below a folder; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def supported(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(*EXTENSIONS)


def sniff(content: Column) -> Column:
    """The format of a file's first bytes, or null."""
    head = F.hex(F.substring(content, 1, 16))
    found = F.lit(None).cast("string")
    for name, digits in reversed(MAGIC):
        found = F.when(head.rlike("^" + digits), name).otherwise(found)
    return found


def places(lines: DataFrame) -> DataFrame:
    """(value: tab-separated line of a place table) -> (place_id, name, lat, lon, country, population); bad lines are left out."""
    c = F.split("value", "\t")
    number = lambda k: F.get(c, F.lit(k)).try_cast("double")
    found = lines.where(F.size(c) >= 19).select(
        F.get(c, F.lit(0)).try_cast("long").alias("place_id"), F.get(c, F.lit(1)).alias("name"), number(4).alias("lat"), number(5).alias("lon"),
        F.get(c, F.lit(8)).alias("country"), F.get(c, F.lit(14)).try_cast("long").alias("population"),
    )
    return found.where("place_id is not null and name <> '' and lat between -90 and 90 and lon between -180 and 180 and not isnan(lat) and not isnan(lon)")


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """(file, track, segment, time, lat, lon, ele) of the timed points of track segments; a track is a row of Spark's XML
    source, and ``track`` its name."""
    kind = "name string, trkseg array<struct<trkpt: array<struct<_lat: double, _lon: double, ele: double, time: string>>>>"
    tracks = spark.read.format("xml").option("rowTag", "trk").schema(kind).load(path)
    rows = tracks.select(F.input_file_name().alias("file"), F.col("name").alias("track"), F.explode("trkseg").alias("s"))
    numbered = rows.withColumn("segment", F.monotonically_increasing_id())
    points = numbered.select("file", "track", "segment", F.explode("s.trkpt").alias("p"))
    found = points.select(
        "file", "track", "segment", F.to_timestamp_ntz(F.regexp_replace("p.time", "Z$", "")).alias("time"),
        F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.col("p.ele").alias("ele"),
    )
    return found.where("time is not null and lat between -90 and 90 and lon between -180 and 180")


def keyword_list_text(paths: DataFrame) -> DataFrame:
    """(path) -> (list, place, value): the tree as lines indented by tabs, every level once, by top-level keyword and place."""
    parts = F.split("path", r"\|")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.slice(parts, F.lit(1), k))
    level = paths.select(F.explode(every).alias("levels")).distinct()
    name = F.element_at("levels", -1)
    line = F.concat(F.repeat(F.lit("\t"), F.size("levels") - 1), name)
    w = Window.partitionBy("list").orderBy("levels")
    return level.select(F.col("levels")[0].alias("list"), "levels", line.alias("value")).withColumn("place", F.row_number().over(w)).select("list", "place", "value")


def parse_keyword_list(lines: DataFrame) -> DataFrame:
    """(list, place, value) of indented lines -> (list, path, synonyms, exported): each line under the last one of the depth above.

    ``{name}`` lines are synonyms of the line before; names in brackets aren't exported."""
    depth = F.length("value") - F.length(F.ltrim("value", F.lit("\t")))
    rows = lines.withColumn("depth", depth).withColumn("name", F.trim(F.ltrim("value", F.lit("\t")))).where("name <> ''")
    synonym = F.col("name").rlike(r"^\{.*\}$")
    w = Window.partitionBy("list").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("synonym", synonym).withColumn("owner", F.last(F.when(~F.col("synonym"), F.col("place")), True).over(w))
    clean = F.regexp_replace("name", r"^\[(.*)\]$", "$1")
    deepest = (rows.agg(F.max("depth")).first()[0] or 0) + 1
    for d in range(deepest):  # the last name of each depth so far, forgotten when a shallower line comes
        at = F.struct("place", clean.alias("name"))
        rows = rows.withColumn(f"_l{d}", F.last(F.when(~F.col("synonym") & (F.col("depth") == d), at), True).over(w))
    fresh = [F.when(F.lit(d) <= F.col("depth"), F.col(f"_l{d}.name")) for d in range(deepest)]
    named = rows.withColumn("path", F.concat_ws("|", *fresh))
    own = named.where("not synonym").select("list", "owner", "path", (~F.col("name").rlike(r"^\[.*\]$")).alias("exported"))
    extra = named.where("synonym").groupBy("list", "owner").agg(F.sort_array(F.collect_list(F.expr("substring(name, 2, length(name) - 2)"))).alias("synonyms"))
    return own.join(extra, ["list", "owner"], "left").select("list", "path", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"), "exported")


class SqliteTable(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """Options: path, table, partitions. A partition is a range of row ids, read on its own connection."""

    def __init__(self, options, columns: list[str]) -> None:
        self.path, self.table, self.n, self.columns = options["path"], options["table"], int(options.get("partitions", 4)), columns

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as con:
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [SqliteTable(0, 0)]
        step = -(-(high - low + 1) // self.n)
        return [SqliteTable(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: SqliteTable) -> Iterator[tuple]:
        with self._open() as con:
            names = ", ".join(f'"{c}"' for c in self.columns)
            yield from con.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """A table of a SQLite file; values of a column whose declared type says otherwise are read as that type or fail."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            columns = con.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        kind = lambda t: "long" if "INT" in t.upper() else "double" if any(x in t.upper() for x in ("REAL", "FLOA", "DOUB")) else "binary" if "BLOB" in t.upper() else "string"
        return ", ".join(f"`{c[1]}` {kind(c[2] or '')}" for c in columns)

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, schema.fieldNames())


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").options(path=path, table=table, partitions=partitions).load()


def foreign_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Photos of a foreign catalog: files joined to folders, roots, images and keywords."""
    t = lambda name: read_sqlite(spark, path, name)
    files, folders, roots, images = t("AgLibraryFile"), t("AgLibraryFolder"), t("AgLibraryRootFolder"), t("Adobe_images")
    words = t("AgLibraryKeywordImage").join(t("AgLibraryKeyword").select(F.col("id_local").alias("tag"), F.col("name").alias("keyword")), "tag")
    tags = words.groupBy(F.col("image").alias("id")).agg(F.sort_array(F.collect_set("keyword")).alias("keywords"))
    placed = (
        images.select(F.col("id_local").alias("id"), F.col("rootFile").alias("file"), "rating", F.col("captureTime").alias("captured"))
        .join(files.select(F.col("id_local").alias("file"), "folder", F.concat("baseName", F.lit("."), "extension").alias("file_name")), "file")
        .join(folders.select(F.col("id_local").alias("folder"), "rootFolder", "pathFromRoot"), "folder")
        .join(roots.select(F.col("id_local").alias("rootFolder"), "absolutePath"), "rootFolder")
        .join(tags, "id", "left")
    )
    return placed.select(
        "id", F.concat("absolutePath", "pathFromRoot", "file_name").alias("path"), "file_name", "rating", "captured",
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
    )
