"""Sorting, paging, counts and trees of the catalog."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from photolith.functions.names import people

SORT_KEYS = {
    "captureDate": ["captured", "imported"],
    "importDate": ["imported"],
    "editDate": ["edited"],
    "fileName": [],
    "rating": ["rating"],
    "fileSize": ["file_size"],
}


def order(key: str = "captureDate", ascending: bool = False, seed: int = 0) -> list[Column]:
    """All keys turn together, ties by lower-cased name and id included; missing values are the smallest."""
    keys = [shuffle_rank("id", seed)] if key == "random" else [F.col(c) for c in SORT_KEYS[key]]
    keys += [F.lower("file_name"), F.col("id")]
    return [k.asc_nulls_first() if ascending else k.desc_nulls_last() for k in keys]


def _mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shuffle_rank(id_column: str, seed: int) -> Column:
    """splitmix64 of the seed and the id; unsigned order as signed numbers, by turning the highest bit."""
    start = _mix64(np.array([seed], np.uint64))[0]

    @F.pandas_udf(LongType())
    def rank(ids: pd.Series) -> pd.Series:
        mixed = _mix64(start ^ ids.to_numpy().astype(np.uint64))
        return pd.Series((mixed ^ np.uint64(1 << 63)).astype(np.int64))

    return rank(id_column)


def page(found: DataFrame, keys: list[Column], offset: int = 0, limit: int = 200) -> DataFrame:
    """Spark takes the first offset + limit rows of each task and merges those, so no full sort is made."""
    return found.orderBy(*keys).offset(offset).limit(limit)


def stats(photos: DataFrame, albums: Column | int = 0) -> DataFrame:
    shown = ~F.col("deleted") & ~F.col("local")
    return photos.agg(
        F.count_if(shown).alias("photos"),
        F.count_if(shown & F.col("is_edited")).alias("edited"),
        F.count_if(shown & (F.col("flag") == "pick")).alias("picks"),
        F.count_if(shown & (F.col("flag") == "reject")).alias("rejects"),
        F.count_if("deleted").alias("deleted"),
        F.max(F.lit(albums)).cast("long").alias("albums"),
    )


def date_groups(photos: DataFrame) -> DataFrame:
    """Counts by year, month and day in one pass; rows of higher levels have nulls below."""
    dated = photos.where(F.col("captured").rlike(r"^\d{4}-\d\d-\d\d"))
    parts = [F.substring("captured", *at).alias(name) for name, at in (("year", (1, 4)), ("month", (6, 2)), ("day", (9, 2)))]
    return dated.select(*parts).rollup("year", "month", "day").agg(F.count("*").alias("n")).where("year is not null")


def keyword_counts(photos: DataFrame) -> DataFrame:
    return photos.select(F.explode("keywords").alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


def levels(path: Column, separator: str = "|") -> Column:
    """All prefixes of a path, the path itself last."""
    parts = F.split(path, rf"\{separator}")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), separator))


def keyword_tree(photos: DataFrame) -> DataFrame:
    """Photos per level of the keyword tree; levels that differ in case only are one, spelled as the lowest id has it.

    Distinct keywords are cut to levels once, in the row, and a photo counts once per level."""
    rows = photos.select("id", F.explode("keywords").alias("keyword")).where(F.trim("keyword") != "")
    rows = rows.select("id", F.explode(levels(F.col("keyword"))).alias("path")).withColumn("level", F.lower("path"))
    per_photo = rows.groupBy("level", "id").agg(F.min("path").alias("path"))
    return per_photo.groupBy("level").agg(F.min_by("path", F.struct("id", "path")).alias("path"), F.count("*").alias("n"))


def people_in(photos: DataFrame) -> DataFrame:
    """Photos per person (names without regard to case) with the first spelling and a cover: the largest frame, then the lowest id."""
    rows = photos.select("id", F.posexplode(people(F.col("names"))).alias("pos", "name"), (F.col("width") * F.col("height")).alias("area"))
    return rows.groupBy(F.lower("name").alias("person")).agg(
        F.min_by("name", F.struct("id", "pos")).alias("name"),
        F.count_distinct("id").alias("n"),
        F.max_by("id", F.struct("area", -F.col("id"))).alias("cover"),
    )


def folder_tree(files: DataFrame, separator: str = "/") -> DataFrame:
    """(path) -> files directly in each folder and in it and below."""
    folder = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    counted = folder.groupBy("folder").agg(F.count("*").alias("own"))
    below = counted.select(F.explode(levels(F.col("folder"), separator)).alias("folder"), F.col("own"))
    return below.groupBy("folder").agg(F.sum("own").alias("total")).join(counted, "folder", "left").select(
        "folder", F.coalesce("own", F.lit(0)).alias("own"), "total"
    )


def histogram(values: DataFrame, column: str, bins: int = 256) -> DataFrame:
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col(column) * (bins - 1) + 0.5)))
    return values.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
