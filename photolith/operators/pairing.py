"""RAW files and the JPEG files that show the same shot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: name endings of RAW files.
RAW_ENDINGS = ["dng", "cr2", "cr3", "nef", "nrw", "arw", "arq", "raf", "orf", "rw2", "rwl", "raw", "pef"]


def folder_of(path: Column) -> Column:
    """Everything before a path's last part; repeated slashes count once."""
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/[^/]*$", "")


def _ending(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def is_raw(kind: Column, path: Column) -> Column:
    return (kind == "raw") | _ending(path).isin(RAW_ENDINGS)


def is_jpeg(kind: Column, path: Column) -> Column:
    return (kind == "image") & _ending(path).isin("jpg", "jpeg")


def raw_jpeg_relations(files: DataFrame) -> DataFrame:
    """(id, path, kind, captured, camera, width, height) -> (raw_id, jpeg_id, relation): pairs that are the same shot.

    A pair has one file stem and one capture time, and either stands in one folder, with cameras that don't differ
    (``sameFolder``), or the JPEG is in a folder inside the RAW's and has its camera, or its size where a camera is
    unknown (``directExport``). Each JPEG goes to the first RAW by path that fits; a RAW can have several.

    What a RAW can be found by is a row per kind of test, of which the first RAW by path is kept; a JPEG looks these up. So
    stems that many folders share, or many files of one shot, make no pairs beyond a JPEG's few look-ups. A blank or null
    camera and sizes of 0 or null are unknown; files without a capture time pair with none."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    told = files.where(F.col("captured").isNotNull()).select(
        "id", "path", "captured", F.coalesce("camera", F.lit("")).alias("camera"), folder_of(F.col("path")).alias("folder"),
        F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("stem"),
        F.when((F.col("width") > 0) & (F.col("height") > 0), F.concat_ws("x", "width", "height")).alias("size"),
        is_raw(F.col("kind"), F.col("path")).alias("raw"), is_jpeg(F.col("kind"), F.col("path")).alias("jpeg"),
    )
    shot = ["test", "folder", "stem", "captured", "camera", "size"]
    blank, any_size = F.lit(""), F.lit("")
    test = lambda name, camera, size, when: F.when(when, F.struct(F.lit(name).alias("test"), camera.alias("camera"), size.alias("size")))
    camera, sized = F.col("camera"), F.col("size").isNotNull()
    named = camera != ""
    always = F.lit(True)
    # by any camera, by its own (or as one without), and by size with any camera or without one
    offers = F.array(
        test("same folder", F.lit("*"), any_size, always), test("same folder", camera, any_size, always),
        test("export, camera", camera, any_size, named), test("export, size", F.lit("*"), F.col("size"), sized), test("export, size", blank, F.col("size"), sized & ~named),
    )
    raws = told.where("raw").select("id", "path", "folder", "stem", "captured", F.explode(F.filter(offers, lambda o: o.isNotNull())).alias("o"))
    raws = raws.select("id", "path", "folder", "stem", "captured", "o.test", "o.camera", "o.size")
    first = raws.groupBy(*shot).agg(F.min(F.struct("path", "id")).alias("first"))
    # a JPEG with a camera takes RAW files of that camera or of none, one without takes any
    asked = F.array(
        test("same folder", F.lit("*"), any_size, ~named), test("same folder", camera, any_size, named), test("same folder", blank, any_size, named),
        test("export, camera", camera, any_size, named), test("export, size", F.lit("*"), F.col("size"), sized & ~named), test("export, size", blank, F.col("size"), sized & named),
    )
    jpegs = told.where("jpeg").select(F.col("id").alias("jpeg_id"), "folder", "stem", "captured", F.explode(F.filter(asked, lambda o: o.isNotNull())).alias("o"))
    inside = F.col("o.test") != "same folder"
    # a folder without a folder around it is in none
    around = F.when(F.contains("folder", F.lit("/")), folder_of(F.col("folder")))
    jpegs = jpegs.select(
        "jpeg_id", F.when(inside, around).otherwise(F.col("folder")).alias("folder"), "stem", "captured", "o.test", "o.camera", "o.size",
        F.when(inside, "directExport").otherwise("sameFolder").alias("relation"),
    )
    best = jpegs.join(first, shot).groupBy("jpeg_id").agg(F.min(F.struct(F.col("first.path").alias("path"), F.col("first.id").alias("id"), "relation")).alias("best"))
    return best.select(F.col("best.id").alias("raw_id"), "jpeg_id", F.col("best.relation").alias("relation"))
