"""Albums, circles, pasted metadata and search patterns against plain Python on small rows."""

import math
import random
import re

from pyspark.sql import functions as F

from photolith.functions.search import has_stem, stem, words_with_stem
from photolith.operators import albums, joins, keywords
from photolith.sources.photos import photos

SF = "/root/testdata/sf0.001"


def metres(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(min(1.0, h)))


def test_circles_of_all_sizes_by_cells(spark):
    rng = random.Random(5)
    spots = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(600)] + [(600, 90.0, 0.0), (601, -90.0, 5.0), (602, 10.0, 180.0), (603, 10.0, -180.0)]
    circles = [(10.0, 179.9, 30_000.0), (89.5, 0.0, 120_000.0), (0.0, 0.0, 0.0), (-60.0, -179.0, 900_000.0), (40.0, 20.0, 4_000_000.0), (spots[7][1], spots[7][2], 1.0), (-89.0, 100.0, 2_000_000.0)]
    held = spark.createDataFrame(circles, "c_lat double, c_lon double, radius_m double")
    asked = spark.createDataFrame(spots, "id long, lat double, lon double")
    want = {i for i, lat, lon in spots if any(metres(lat, lon, a, b) <= r for a, b, r in circles)}
    assert 7 in want and 600 in want and 602 in want and 603 in want
    assert sorted(r.id for r in joins.inside_any(asked, held).collect()) == sorted(want)
    assert joins.inside_any(asked, held.limit(0)).count() == 0


def test_patterns_find_the_words_that_stems_find(spark):
    for own in ("dog", "puppy", "beach", "cat", "wolf", "bus"):
        made = {own + e for e in ("", "s", "es", "ing", "ed", "ies", "x")} | {own[:-1] + "ies"}
        assert {w for w in made if stem(w) == own} <= set(words_with_stem(own))
    texts = ["Two DOGS here", "dogma", "a-dog_b", "hotdog", "dogé", "puppies!", "the\ndoging", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(has_stem(F.col("t"), ["dog", "puppy"]).alias("hit")).collect()
    want = [any(stem(w) in ("dog", "puppy") for w in re.findall(r"[^\W_]+", t)) for t in texts]
    assert [r.hit for r in got] == want


def test_albums_lose_their_places_in_one_folder(spark):
    rows = [(1, None, "b", False, 2), (2, None, "A", False, None), (3, 9, "c", False, 1), (4, None, "z", True, None)]
    table = spark.createDataFrame(rows, "id long, parent long, name string, folder boolean, place int")
    listed = {r.id: r.listed for r in albums.siblings(table).collect()}
    assert listed == {4: 1, 1: 2, 2: 3, 3: 1}
    after = {r.id: (r.place, r.changed) for r in albums.sort_by_name(table, None).collect()}
    assert after == {1: (None, True), 2: (None, False), 3: (1, False), 4: (None, False)}


def test_merged_keywords_are_one_but_for_case(spark):
    row = spark.range(1).select(keywords.merge(F.array(F.lit("Sea|Fish"), F.lit("sea"), F.lit(" "), F.lit("Water")), {"sea": "Water"}).alias("k")).first()
    assert row.k == ["Water|Fish", "Water"]


def test_pasting_nothing_and_from_nowhere(spark):
    rows = spark.createDataFrame([(1, 3, None, ["a"]), (2, 5, "red", [])], "id long, rating int, label string, keywords array<string>")
    fields = ["rating", "label", "keywords"]
    got = {r.id: (r.rating, r.label, r.keywords) for r in albums.paste_metadata(rows, 1, F.col("id") == 2, fields).collect()}
    assert got == {1: (3, None, ["a"]), 2: (3, None, ["a"])}
    assert albums.paste_metadata(rows, 7, F.lit(True), fields).collect() == rows.collect()
    emptied = albums.paste_metadata(rows, 2, F.lit(True), ["keywords"]).where("id = 1").first()
    assert emptied.keywords == []


def test_no_text_is_shuffled_for_its_hash(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = photos(spark, SF).select("id", "content_hash", "flag")
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = plan[: plan.index("Relation")].splitlines()
    join = next(k for k, line in enumerate(above) if "Join" in line)
    assert not any("text#" in line for line in above[: join + 1]) and any("md5" in line for line in above[join:])
