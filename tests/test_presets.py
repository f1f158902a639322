"""Saved filters, typed positions, offsets and arrivals on small rows."""

import pytest
from pyspark.sql import functions as F

from photolith.functions.times import offset_minutes, utc_seconds
from photolith.operators import filters, joins
from photolith.operators.filters import Filter


def test_presets_are_replaced_in_any_case():
    saved = filters.save_preset({}, " Trips ", Filter(rating=3))
    saved = filters.save_preset(saved, "Late", Filter(flag="pick"))
    saved = filters.save_preset(saved, "TRIPS", Filter(rating=5))
    assert list(saved) == ["TRIPS", "Late"] and filters.preset(saved, "trips") == Filter(rating=5)
    assert list(filters.delete_preset(saved, "late")) == ["TRIPS"]
    for name, f in (("  ", Filter(rating=1)), ("x", Filter())):
        with pytest.raises(ValueError):
            filters.save_preset(saved, name, f)
    with pytest.raises(KeyError):
        filters.delete_preset(saved, "none")


def test_offsets(spark):
    texts = ["+05:30", "-0330", "Z", "+2", "-18:59", "+19:00", "+02:60", "", "UTC", None, "+01:00\0"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r[1] for r in rows.select("k", offset_minutes(F.col("t"))).orderBy("k").collect()]
    assert got == [330, -210, 0, 120, -1139, None, None, None, None, None, 60]
    row = spark.range(1).select(utc_seconds(F.lit("2024:02:29 10:00:00"), F.lit("+10:00")).alias("a"), utc_seconds(F.lit("2023:02:29 10:00:00"), F.lit("Z")).alias("b")).first()
    assert row["a"] == 1709164800 and row["b"] is None


def test_place_search(spark):
    named = spark.createDataFrame(
        [("place", "Norwood", 1.0, 2.0), ("location", "wood", 3.0, 4.0), ("place", "Woodside", 5.0, 6.0), ("place", "Wood", 7.0, 8.0), ("place", "Woodend", 95.0, 1.0), ("place", None, 1.0, 1.0)],
        "kind string, name string, lat double, lon double",
    )
    assert [r["name"] for r in joins.search_places(named, " WOOD ").collect()] == ["Wood", "wood", "Woodside", "Norwood"]
    assert [r["name"] for r in joins.search_places(named, "wood", 2).collect()] == ["Wood", "wood"]
    assert joins.search_places(named, " ").count() == 0
    typed = joins.search_places(named, "48.5, 2").collect()
    assert [(r["kind"], r["lat"], r["lon"]) for r in typed] == [("position", 48.5, 2.0)]


def test_places_filled_or_overwritten(spark):
    photos = spark.createDataFrame([(1, "", "Rome", " ", None), (2, "", "", "", "")], "id long, location string, city string, state string, country string")
    nearest = spark.createDataFrame([(1, 9)], "id long, place_id long")
    places = spark.createDataFrame([(9, "", "Ostia", "Lazio", "Italy")], "place_id long, location string, city string, state string, country string")
    kept, replaced = (sorted(map(tuple, joins.fill_place(photos, nearest, places, o).collect())) for o in (False, True))
    assert kept == [(1, "", "Rome", "Lazio", "Italy"), (2, "", "", "", "")]
    assert replaced == [(1, "", "Ostia", "Lazio", "Italy"), (2, "", "", "", "")]


def test_deleted_files_do_not_come_back(spark):
    library = spark.createDataFrame([("/a", True), ("/b", False), ("/c", True), ("/c", False)], "path string, deleted boolean")
    files = spark.createDataFrame([(1, "/a"), (2, "/b"), (3, "/c"), (4, "/d"), (5, None)], "id long, path string")
    got = {r["id"]: r["outcome"] for r in joins.arrivals(files, library).collect()}
    assert got == {1: "deleted", 2: "known", 3: "known", 4: "new", 5: "new"}
