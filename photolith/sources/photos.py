"""The photo tables, as views over the given tables.

A document stands for a photo, a part's name and type for its keywords, conversations for stacks, click events for a
track log. Every column is a deterministic expression on the key, written once where Spark and DuckDB agree on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

#: Fixed points of the synthetic time line.
EPOCH = 1577836800
NOW = "2024-06-01T00:00:00"

#: (column, Spark expression, DuckDB expression if it differs)
_SECONDS = f"({EPOCH} + doc_id * 37123)"
_PHOTO: list[tuple[str, str, str | None]] = [
    ("id", "doc_id", None),
    ("file_name", "concat(CASE WHEN doc_id % 7 = 3 THEN 'DSC_' ELSE 'img_' END, cast(doc_id % 97 as string), CASE WHEN doc_id % 29 = 4 THEN '-HDR' WHEN doc_id % 31 = 5 THEN '-Pano' WHEN doc_id % 37 = 6 THEN '-HDR-Pano-2' ELSE '' END, CASE doc_id % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.raf' WHEN 2 THEN '.dng' WHEN 3 THEN '.jpg' ELSE '' END)", None),
    ("path", "concat('/photos/', source, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('/', lang) END, '/img_', cast(doc_id as string))", None),
    ("format", "CASE doc_id % 5 WHEN 1 THEN 'RAF' WHEN 2 THEN 'DNG' ELSE 'JPEG' END", None),
    ("kind", "CASE WHEN doc_id % 41 = 7 THEN 'video' ELSE 'photo' END", None),
    ("duration", "CASE WHEN doc_id % 41 = 7 THEN cast(doc_id % 300 as double) END", None),
    ("rating", "cast(doc_id % 6 as int)", None),
    ("flag", "CASE quality WHEN 1 THEN 'pick' WHEN 0 THEN 'reject' ELSE 'none' END", None),
    ("label", "CASE doc_id % 7 WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' WHEN 2 THEN 'green' WHEN 3 THEN 'blue' WHEN 4 THEN 'purple' END", None),
    ("deleted", "coalesce(toxic, 0) = 1", None),
    ("local", "doc_id % 23 = 11", None),
    ("captured", f"CASE WHEN doc_id % 17 <> 0 THEN date_format(timestamp_seconds({_SECONDS}), \"yyyy-MM-dd'T'HH:mm:ss\") END",
     f"CASE WHEN doc_id % 17 <> 0 THEN strftime(make_timestamp({_SECONDS} * 1000000), '%Y-%m-%dT%H:%M:%S') END"),
    ("captured_secs", f"CASE WHEN doc_id % 17 <> 0 THEN {_SECONDS} END", None),
    ("imported", "concat('2024-0', cast(1 + doc_id % 5 as string), '-', CASE WHEN doc_id % 28 < 9 THEN '0' ELSE '' END, cast(1 + doc_id % 28 as string), 'T10:00:00')", None),
    ("edited", "CASE WHEN doc_id % 4 = 1 THEN concat('2024-05-1', cast(doc_id % 10 as string), 'T08:30:00') END", None),
    ("is_edited", "doc_id % 4 = 1", None),
    ("is_cropped", "doc_id % 8 = 1", None),
    ("treatment", "CASE WHEN doc_id % 9 = 2 THEN 'monochrome' ELSE 'color' END", None),
    ("copy_of", "CASE WHEN doc_id % 19 = 8 THEN doc_id - 1 END", None),
    ("copy_name", "CASE WHEN doc_id % 19 = 8 THEN 'Copy 1' END", None),
    ("title", "concat('Photo of ', CASE doc_id % 6 WHEN 0 THEN 'dogs' WHEN 1 THEN 'a sunset' WHEN 2 THEN 'the coast' WHEN 3 THEN 'cities' ELSE 'people' END)", None),
    ("caption", "text", None),
    ("alt_text", "CASE WHEN doc_id % 10 = 6 THEN 'walking puppies' ELSE '' END", None),
    ("camera", "concat('Cam X', cast(doc_id % 4 as string))", None),
    ("lens", "concat('Lens ', cast(18 + doc_id % 9 as string), 'mm F2')", None),
    ("iso", "CASE WHEN doc_id % 13 <> 5 THEN cast(100 * (1 + doc_id % 64) as int) END", None),
    ("aperture", "CASE WHEN doc_id % 13 <> 5 THEN cast(14 + doc_id % 80 as double) / 10 END", None),
    ("focal", "CASE WHEN doc_id % 13 <> 5 THEN cast(14 + doc_id % 187 as double) END", None),
    ("shutter", "CASE WHEN doc_id % 13 = 5 THEN '' WHEN doc_id % 10 = 9 THEN concat(cast(1 + doc_id % 30 as string), '\"') ELSE concat('1/', cast(1 + doc_id % 4000 as string)) END", None),
    ("width", "cast(3000 + 500 * (doc_id % 5) as int)", None),
    ("height", "cast(3000 + 250 * (doc_id % 9) as int)", None),
    ("swapped", "doc_id % 4 = 3", None),
    ("lat", "CASE WHEN doc_id % 5 <> 0 THEN cast(doc_id * 7919 % 14000 as double) / 100 - 70 END", None),
    ("lon", "CASE WHEN doc_id % 5 <> 0 THEN cast(doc_id * 104729 % 36000 as double) / 100 - 180 END", None),
    ("location", "CASE WHEN doc_id % 6 = 1 THEN 'Old Harbour' ELSE '' END", None),
    ("city", "CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('City ', cast(doc_id % 25 as string)) END", None),
    ("state", "CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE '' END", None),
    ("country", "CASE WHEN doc_id % 3 = 0 THEN '' ELSE upper(lang) END", None),
    ("creator", "source", None),
    ("copyright", "CASE WHEN doc_id % 4 <> 2 THEN concat('(c) ', source) END", None),
    ("usage_terms", "CASE WHEN doc_id % 9 = 0 THEN 'No resale' ELSE '' END", None),
    ("copyright_url", "CASE WHEN doc_id % 11 = 0 THEN concat('https://example.org/', cast(doc_id % 7 as string)) END", None),
    ("extended_description", "CASE WHEN doc_id % 12 = 1 THEN 'A longer description for those who cannot see it' END", None),
    ("copyright_status", "CASE doc_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'copyrighted' ELSE 'public' END", None),
    ("file_size", "n_chars", None),
    ("content_hash", "md5(text)", None),
    ("keywords", "split(concat('Nature|', CASE doc_id % 4 WHEN 0 THEN 'Bird|Owl' WHEN 1 THEN 'tree' WHEN 2 THEN 'Tree|Oak' ELSE 'Sea' END, ';', CASE WHEN doc_id % 2 = 0 THEN 'travel|italy|rome' ELSE 'Travel|France' END, CASE WHEN doc_id % 5 = 0 THEN concat(';', lang) ELSE '' END, CASE WHEN doc_id % 7 = 0 THEN ';nature|Sea; ' ELSE '' END), ';')", None),
    ("names", "split(concat('Ann', CASE WHEN doc_id % 3 = 0 THEN ';Bob' ELSE '' END, CASE WHEN doc_id % 4 = 0 THEN '; ann;Eve' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN '; ' ELSE '' END), ';')", None),
    ("sharpness", "CASE WHEN doc_id % 6 <> 4 THEN cast(doc_id * 31 % 1000 as double) / 10 END", None),
    ("burst", "CASE WHEN doc_id % 6 <> 4 AND doc_id % 3 = 0 THEN doc_id % 40 END", None),
    ("best", "CASE WHEN doc_id % 6 <> 4 THEN doc_id % 12 = 3 END", None),
]

PHOTOS_CTE = "photos AS (SELECT " + ", ".join(f"{duck or spark} AS {name}" for name, spark, duck in _PHOTO) + " FROM documents LEFT JOIN labels USING (doc_id))"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files. It may be one file or a folder of files of any names: as a pattern its path stands
    for both, while a plain path would have to be a folder."""
    return spark.readStream.schema(read(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}[.]parquet")


def photos(spark: SparkSession, sf_dir: str, made: dict[str, Column] | None = None) -> DataFrame:
    """All photos. Columns that a query doesn't use never leave the scan, the text among them; what is made of the text is
    made before the join, so that no text is shuffled unless its caption is asked for. ``made``: further columns, of those
    that don't come from the labels, which are made there too."""
    judged = {"flag", "deleted"}  # these come from the labels
    own = [f"{spark_expr} AS {name}" for name, spark_expr, _ in _PHOTO if name not in judged]
    docs = read(spark, sf_dir, "documents").selectExpr("doc_id", *own).withColumns(made or {})
    docs = docs.join(read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return docs.selectExpr(*[f"{spark_expr} AS {name}" if name in judged else name for name, spark_expr, _ in _PHOTO], *(made or {}))


def visible(photos_df: DataFrame) -> DataFrame:
    """Photos in the library: not deleted and not merely browsed."""
    return photos_df.where("not deleted and not local")


#: A path's folder, its parents and itself, from ``pages.url``: host and path segments without query and fragment.
def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return pages.selectExpr("page_id AS id", "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path")


FOLDERS_CTE = "folders AS (SELECT page_id AS id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages)"
