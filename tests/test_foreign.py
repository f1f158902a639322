"""Other programs' collections and entities, temperatures of light, tracks and saved places on small rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from photolith.functions import temperature
from photolith.operators import bulk, foreign, joins, sequences
from photolith.operators.filters import Filter


def test_criteria_become_rules_all_or_none():
    told = foreign.translate(
        'anything = { { criteria = "rating", operation = "<=", value = "4" }, { criteria = "pick", operation = "!=", value = -1 }, { criteria = "iso", operation = "in", value = 100, value2 = 400, },'
        ' { combine = "union"; { criteria = "filename", operation = "beginsWith", value = "IMG \\"1\\"" }; { criteria = "captureTime", operation = "<", value = "2021" } } }'
    )
    assert told == {"match": "all", "rules": [
        {"field": "rating", "op": "lte", "value": 4.0}, {"field": "flag", "op": "isNot", "value": "reject"}, {"field": "iso", "op": "between", "value": [100.0, 400.0]},
        {"group": {"match": "any", "rules": [{"field": "fileName", "op": "startsWith", "value": 'IMG "1"'}, {"field": "captureDate", "op": "before", "value": "2021"}]}},
    ]}
    assert foreign.translate('x = { { criteria = "keywords", operation = "noneOf", value = "sea" }, combine = "exclude" }')["match"] == "none"
    with pytest.raises(foreign.Unmapped) as e:
        foreign.translate('s = { { criteria = "keywords", operation = "endsWith", value = "a" }, { criteria = "crop" }, { criteria = "rating", operation = "==", value = 1 } }')
    assert e.value.reasons == ["criterion keywords endsWith", "criterion crop"]
    one = '{ criteria = "rating", operation = "==", value = 1 }'
    for bad in ("", "s = {}", "s = 5", "s = {", 's = { "a }', f"s = {{ {one}, combine = 'x' }}", f's = {{ {one}, combine = "sum" }}', "s = " + "{" * 12 + one + "}" * 12, "s = {" + (one + ",") * 300 + "}", f"s = {one}"):
        with pytest.raises(foreign.Unmapped):
            foreign.translate(bad)


def test_entities_become_a_filter():
    e = lambda kind, text, *sure: {"type": kind, "text": text} | ({"confidence": sure[0]} if sure else {})
    found = foreign.entities_filter([e("keyword", "dunes"), e("KEYWORD", "Dunes"), e("keyword", "red sky"), e("place", "Sahara:south"), e("rating", "ten"), e("rating", "about 4"), e("rating_comparison", "only"),
                                     e("flag", "flagged ones"), e("color_label", "dark blue"), e("file_type", "RAW files"), e("edited", "maybe"), e("person", "Ann", 0.49), e("person", "Bo", 0.5), e("lens", "\x0750mm"),
                                     e("camera", ""), e("date_from", "2024-02-30"), e("date_from", "2024-02-29"), e("date_to", "1500"), e("mood", "happy"), e("camera", 5), e("edited", "no", float("nan"))])
    assert found == Filter(text="Sahara south red sky", rating=4, rating_op="exactly", flag="pick", label="blue", kind="raw", keyword="dunes", person="Bo", lens="50mm", date_from="2024-02-29")
    assert foreign.entities_filter([]) == Filter()


def test_temperatures_are_found_again(spark):
    rows = [(k, float(t)) for k in (1200.0, 1667.0, 2000.0, 2856.0, 4000.0, 6500.0, 15000.0, 25000.0, 40000.0) for t in (-80, 0, 20)]
    frame = spark.createDataFrame(rows, "k double, t double").withColumn("p", temperature.temperature_to_xy(F.col("k"), F.col("t")))
    for r in frame.withColumn("f", temperature.xy_to_temperature(F.col("p.x"), F.col("p.y"))).collect():
        assert abs(r["f"]["kelvin"] - r["k"]) < 0.01 * r["k"] and abs(r["f"]["tint"] - r["t"]) < 1
    white = spark.range(1).select(temperature.xy_to_temperature(F.lit(0.31271), F.lit(0.32902)).alias("f")).first()["f"]
    assert abs(white["kelvin"] - 6504) < 60 and abs(white["tint"]) < 15


def brute_locate(points, t, gap):
    """points: (t, lat, lon, ele, segment) in order."""
    later = next((k for k, p in enumerate(points) if p[0] >= t), len(points))
    a, b = points[later - 1] if later else None, points[later] if later < len(points) else None
    if b and b[0] == t:
        return (*b[1:4], "interpolated")
    if a and b and a[4] == b[4] and b[0] - a[0] <= gap:
        s = (t - a[0]) / (b[0] - a[0])
        turn = (b[2] - a[2] + 180) % 360 - 180
        lon = (a[2] + turn * s + 180) % 360 - 180
        ele = a[3] + (b[3] - a[3]) * s if a[3] is not None and b[3] is not None else a[3] if a[3] is not None else b[3]
        return a[1] + (b[1] - a[1]) * s, lon, ele, "interpolated"
    near = a if a and (not b or t - a[0] <= b[0] - t) else b
    return (*near[1:4], "nearest") if near and abs(near[0] - t) <= gap else None


def test_places_on_tracks(spark):
    rng = random.Random(1)
    track, asked, want = [], [], {}
    for user in range(6):
        points = sorted(((float(rng.randint(0, 300)), rng.uniform(-80, 80), rng.uniform(-179, 179), rng.choice([None, 5.0, 9.0]), rng.randint(0, 1)) for _ in range(user * 6)), key=lambda p: p[0])
        track += [(user, t, k, *rest) for k, (t, *rest) in enumerate(points)]
        for k in range(60):
            t = rng.choice([float(rng.randint(-30, 330)), rng.uniform(-30, 330)])
            asked.append((user, user * 100 + k, t))
            if (found := brute_locate(points, t, 25.0)) is not None:
                want[user * 100 + k] = found
    frame = spark.createDataFrame
    got = joins.locate(frame(asked, "user int, id long, t double"), frame(track, "user int, t double, seq int, lat double, lon double, ele double, segment int"), "user", 25.0)
    got = {r["id"]: (r["lat"], r["lon"], r["ele"], r["how"]) for r in got.collect()}
    assert set(got) == set(want)
    for i, w in want.items():
        assert got[i][3] == w[3] and (got[i][2] is None) == (w[2] is None)
        assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(got[i][:3], w[:3]) if x is not None)
    row = spark.range(1).select(joins.utc_seconds(F.lit(7200), F.lit(None).cast("int"), 60).alias("a"), joins.utc_seconds(F.lit(7200), F.lit(-30), 60).alias("b"), joins.utc_seconds(F.lit(7200), F.lit(None).cast("int")).alias("c")).first()
    assert tuple(row) == (3600, 9000, 7200)


def test_photos_per_saved_location(spark):
    rng = random.Random(3)
    spots = [(k, rng.choice([None, rng.uniform(-90, 90)]), rng.uniform(-180, 180)) for k in range(400)] + [(900, 10.0, 179.95), (901, 10.0, 179.95), (902, 89.9, 3.0)]
    circles = [(1, 10.0, -179.9, 40_000.0), (2, 90.0, 0.0, 20_000.0), (3, 0.0, 0.0, 3_000_000.0), (4, -45.0, 20.0, 0.0), (5, 10.0, 179.95, 0.0)]
    got = joins.circle_counts(spark.createDataFrame(spots, "id long, lat double, lon double"), spark.createDataFrame(circles, "circle long, c_lat double, c_lon double, radius_m double"))

    def metres(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(min(1.0, h)))

    want = {c: sum(lat is not None and metres(lat, lon, a, b) <= r for _, lat, lon in spots) for c, a, b, r in circles}
    assert {r["circle"]: r["n"] for r in got.collect()} == want and want[1] >= 2 and want[5] == 2


def brute_arranged(rows):
    """Rows (id, stack_id, stack_pos, collapsed, key) as the grid lists them."""
    out, done = [], set()
    for i, stack, *_ in sorted(rows, key=lambda r: (r[4], r[0])):
        if stack is None:
            out.append(i)
        elif stack not in done:
            done.add(stack)
            members = sorted((r for r in rows if r[1] == stack), key=lambda r: (r[2], r[0]))
            out += [m[0] for m in (members[:1] if members[0][3] else members)]
    return out


def test_stacks_stand_where_their_first_stands(spark):
    rng = random.Random(5)
    rows = [(k, s, rng.randint(0, 4), s is not None and s % 2 == 0, rng.randint(0, 20)) for k in range(120) for s in [rng.choice([None, *range(25)])]]
    frame = spark.createDataFrame(rows, "id long, stack_id long, stack_pos int, collapsed boolean, key int")
    got = [r["id"] for r in sequences.stacks_in_order(frame, ["key", "id"]).orderBy("anchor", "stack_place").collect()]
    assert got == brute_arranged(rows)


def test_selection_by_tests(spark):
    shown = spark.createDataFrame([(1, "pick", 5, None), (2, "none", 3, "red"), (3, "reject", 5, "red")], "id long, flag string, rating int, label string")
    ids = lambda **told: sorted(r["id"] for r in bulk.select_by(shown, **told).collect())
    assert ids(flag="pick") == [1] and ids(rating=4) == [1, 3] and ids(rating=3, rating_op="lte") == [2] and ids(rating=9, rating_op="eq") == [1, 3]
    assert ids(label="none") == [1] and ids(label="red", rating=5) == [3] and ids(label="red", add_to=shown.where("id < 3")) == [1, 2, 3]
    for bad in ({}, {"label": "mauve"}, {"flag": "maybe"}):
        with pytest.raises(ValueError):
            ids(**bad)
