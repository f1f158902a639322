"""Queries on tables as they are when they are large: folders of files, keys beyond those of the given tables."""

import math
import os
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from photolith.functions import pixels, temperature
from photolith.operators import faces, joins, vectors
from photolith.plans.registry import ORACLE_SQL, QUERIES
from photolith.streaming import logs
from tests.test_entry import SF, TABLES, rows
from tests.test_upkeep import brute_groups

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def agrees(spark, name, tables):
    """Whether a query and its SQL agree over the given tables and those of ``tables`` (name: folder of files)."""
    folder = next(iter(tables.values())).parent
    con = duckdb.connect()
    for t in TABLES:
        if t not in tables:
            (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables[t]}/*.parquet'" if t in tables else f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, str(folder)), con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    named = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert named
    return rows([r.asDict() for r in got.collect()], columns) == rows(named, columns)


def copied(spark, tmp_path, table, **shifted):
    """The table as a folder of several files, with ``shifted`` columns replaced by expressions."""
    df = spark.read.parquet(f"{SF}/{table}.parquet")
    kinds = {c: df.schema[c].dataType for c in shifted}
    df.selectExpr(*[f"cast({shifted[c]} as {kinds[c].simpleString()}) as {c}" if c in shifted else c for c in df.columns]).repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    return {table: tmp_path / f"{table}.parquet"}


@pytest.mark.parametrize("name, table", [("stream_arrivals", "documents"), ("stream_fold", "events"), ("stream_daily_counts", "events"), ("face_index", "embeddings")])
def test_a_stream_of_a_folder_of_files(spark, tmp_path, name, table):
    assert agrees(spark, name, copied(spark, tmp_path, table))


def test_dates_of_later_centuries_are_dates(spark, tmp_path):
    assert agrees(spark, "filter_token_flags", copied(spark, tmp_path, "documents", doc_id="doc_id * 499 + 3") | copied(spark, tmp_path, "labels", doc_id="doc_id * 499 + 3"))


def test_tracks_of_users_with_large_numbers(spark, tmp_path):
    assert agrees(spark, "gpx_round_trip", copied(spark, tmp_path, "events", user_id="user_id * 4001"))


def test_a_signature_takes_its_sums_once(spark):
    """Of 300 pixels: with the mean or the length worked out for each pixel anew this takes hours."""
    values = [math.sin(k * k) for k in range(300)]
    frame = spark.createDataFrame([(values,), ([2.0] * 300,), (None,)], "v array<float>").select(pixels.signature(F.col("v")).alias("s"))
    began = time.monotonic()
    got, flat, null = (r["s"] for r in frame.collect())
    assert time.monotonic() - began < 60
    v = np.array(values, np.float32).astype(float)
    v -= v.mean()
    assert np.allclose(got, v / np.sqrt((v * v).sum())) and flat is None and null is None


def test_many_temperatures_are_found_and_agree_with_sql(spark, tmp_path):
    """All 220 temperatures and 61 tints; row by row this took minutes. One of them lies where a rounding turns."""
    spark.range(13420).selectExpr("id AS p_partkey").repartition(3).write.parquet(str(tmp_path / "part.parquet"))
    began = time.monotonic()
    assert agrees(spark, "colour_temperature", {"part": tmp_path / "part.parquet"})
    assert time.monotonic() - began < 60


def test_no_temperature_without_a_position(spark):
    frame = spark.createDataFrame([(None, 0.3), (0.3, float("nan")), (0.31271, 0.32902)], "x double, y double")
    got = [r["f"] for r in frame.select(temperature.xy_to_temperature(F.col("x"), F.col("y")).alias("f")).collect()]
    assert [f and f["kelvin"] for f in got[:2]] == [None, None] and abs(got[2]["kelvin"] - 6504) < 60


def test_files_that_stay_as_they_are_are_taken_once(spark, tmp_path):
    """Scans that come in several runs, against a loop; all paths of a batch in one plan, without a Python call for each."""
    rng = random.Random(3)
    scans = [[(f"/{p}", n, rng.choice([0, 1, 1, 2])) for p in range(40) for n in range(4 * run, 4 * run + rng.randint(0, 4))] for run in range(3)]
    want, size, done = [], {}, set()
    for run in scans:
        for path, n, now in run:
            if path not in done and now > 0 and size.get(path) == now:
                done.add(path)
                want.append((path, n, now))
            size[path] = now
        rng.shuffle(run)
        spark.createDataFrame(run, "path string, scan long, size long").repartition(2).write.mode("append").parquet(str(tmp_path / "scans"))
        stream = spark.readStream.schema("path string, scan long, size long").parquet(str(tmp_path / "scans"))
        assert sorted(tuple(r) for r in logs.run_stable(stream, spark, str(tmp_path / "out")).collect()) == sorted(want)


def test_cells_of_circles_are_dealt_by_their_number(spark, monkeypatch):
    """Circles are few rows and very many cells: they aren't broadcast, and more cells go to more partitions."""
    rng = random.Random(8)
    spots = spark.createDataFrame([(k, rng.uniform(-70, 70), rng.uniform(-180, 180)) for k in range(300)], "id long, lat double, lon double")
    circles = spark.createDataFrame([(k, rng.uniform(-70, 70), rng.uniform(-180, 180), rng.uniform(0, 900_000.0)) for k in range(40)], "circle long, c_lat double, c_lon double, radius_m double")
    want = sorted(tuple(r) for r in joins.circle_counts(spots, circles).collect())
    monkeypatch.setattr(joins, "CIRCLE_CELLS", 100)
    found = joins.circle_counts(spots, circles)
    plan = found._jdf.queryExecution().toString()
    parts = {int(n) for n in re.findall(r"hashpartitioning\(cy#\d+L, cx#\d+L, (\d+)\)", plan)}
    assert len(parts) == 1 and min(parts) > 20
    assert sorted(tuple(r) for r in found.collect()) == want and sum(n for _, n in want) > 0


def test_vectors_are_sent_as_often_on_more_rows(spark, monkeypatch):
    """Twenty times the rows go to as many blocks; and groups that hold few scores at once find the same."""
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=6)], k % 3) for k in range(400)]
    few, many = (spark.createDataFrame(rows[:n], "id long, embedding array<float>, person int") for n in (20, 400))
    assert vectors.grid(few, few, 4000) == vectors.grid(many, many, 4000) == (2, 2)
    assert vectors.grid(many, few, 50) == (8, 2)
    monkeypatch.setattr(vectors, "HELD_SCORES", 500)
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    want = {(k, p): np.sort((v @ v[k])[[i for i in range(400) if i % 3 == p]])[-2:].mean() for k in range(400) for p in range(3)}
    got = {(r["id"], r["person"]): r["score"] for r in vectors.rank_people(many.select("id", "embedding"), many.select("person", "embedding"), 2, 64).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_faces_far_apart_in_the_table_share_a_group(spark, tmp_path):
    """Three copies of a table, 1500 rows: those of a vector that aren't marked are in one group, however far apart their ids."""
    given = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet' WHERE vec_id < 500").fetchall()
    table = [(k + 500 * copy, v, label) for copy in range(3) for k, v, label in given]
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["id"]: r["cluster"] for r in QUERIES["face_clusters"](spark, str(tmp_path)).collect()}
    assert len(got) == 1500 and all(len({got[k + 500 * copy] for copy in range(3)}) == 1 for k in range(500) if k % 5 != 1)
    # its best two are copies of itself, so a marked face resembles whom it isn't
    assert all(got[k] == k for k in got if k % 5 == 1)


@pytest.mark.parametrize("together", [1 << 20, 1600])
def test_groups_of_all_faces_together(spark, monkeypatch, together):
    """As brute force over one pass, merged in one task and in rounds of all tasks; with copies, and vectors without likeness."""
    monkeypatch.setattr(faces, "TOGETHER", together)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 16))
    ids = sorted(rng.choice(10**7, 1100, replace=False).tolist())
    drawn = centres[rng.integers(0, 40, 1100)] + 0.6 * rng.normal(size=(1100, 16))
    drawn /= np.linalg.norm(drawn, axis=1, keepdims=True)
    given = [(i, v.astype(np.float32).tolist()) for i, v in zip(ids, drawn, strict=True)]
    for k in range(60):
        given[1000 + k] = (ids[1000 + k], given[k % 20][1])
    given[63], given[64], given[65], given[900], given[901] = (ids[63], None), (ids[64], [float("nan")] * 16), (ids[65], [1.0, 0.0]), (ids[900], []), (ids[901], [1.0, 0.0])
    known = [(f"p{k % 5}", (centres[k % 5] / np.linalg.norm(centres[k % 5])).astype(np.float32).tolist()) for k in range(12)]
    marks = [(ids[k], f"p{k % 5}") for k in range(0, 1100, 3)]
    frame = spark.createDataFrame
    odd = [("p0", None), ("p0", [float("nan")] * 16), ("p4", [0.0, 1.0])]
    found = faces.face_groups(frame(given, "id long, embedding array<float>"), frame([*marks, (ids[1], None)], "id long, person string"), frame(known + odd, "person string, embedding array<float>"), 0.55, None)
    resembles = set()
    for i, v in given:
        if v is not None and len(v) == 16 and np.isfinite(v).all():
            for person in {p for p, _ in known}:
                if np.mean(sorted((float(np.dot(v, w)) for p, w in known if p == person), reverse=True)[:2]) >= 0.55:
                    resembles.add((i, person))
    want = brute_groups(given, marks, resembles, 0.55, len(given))
    assert {r["id"]: (r["cluster"], r["size"]) for r in found.collect()} == want and resembles
    assert any(abs(ids.index(i) - ids.index(c)) >= 1000 for i, (c, _) in want.items())


def test_merging_in_rounds_is_merging_one_by_one():
    """Of vectors whose products are exact, so that there are many ties, with and without rows kept apart."""
    rng = np.random.default_rng(3)
    for trial in range(30):
        held = np.zeros((50, 10))
        for row in held:
            row[rng.choice(6 + trial % 5, 4, replace=False)] = 0.5 * rng.choice([-1, 1, 1], 4)
        tags = ({}, {}) if trial % 3 else tuple({0: np.flatnonzero(rng.random(50) < share)} for share in (0.1, 0.4))
        mean = held @ held.T
        np.fill_diagonal(mean, -np.inf)
        for p in tags[0]:
            mean[np.ix_(tags[0][p], tags[1][p])] = -np.inf
            mean[np.ix_(tags[1][p], tags[0][p])] = -np.inf
        got = faces.merge_nearest(held, np.ones(50), tags, np.full(50, -1), np.full(50, -np.inf), 0.25)
        assert got.tolist() == faces.merge_groups(mean, 0.25).tolist()


def test_bests_in_a_ring_still_merge(spark):
    """As the last digits of equal likenesses could have it, each other's best is another: the highest, lowest pair merges."""
    ring = faces.merge_nearest(np.eye(4)[[0, 0, 0, 1]], np.ones(4), ({}, {}), np.array([1, 2, 0, -1]), np.array([1.0, 1.0, 1.0, -np.inf]), 0.5)
    assert ring.tolist() == [0, 0, 0, 3]
    state = spark.createDataFrame([(7, 5, 0.9), (5, 6, 0.9), (6, 7, 0.9), (8, 6, 0.7)], "label long, best long, score double")
    assert sorted((r["label"], r["best"]) for r in faces._highest_first(state).collect()) == [(5, 6), (6, 5), (7, 5), (8, 6)]
