"""File sources on small literal files."""

import sqlite3

from pyspark.sql import functions as F

from photolith.operators import bulk, changes, sequences
from photolith.sources import files, metadata


def test_sqlite_tables_and_a_foreign_catalog(spark, tmp_path):
    path = str(tmp_path / "catalog.db")
    with sqlite3.connect(path) as con:
        con.executescript(
            """
            CREATE TABLE AgLibraryRootFolder (id_local INTEGER PRIMARY KEY, absolutePath TEXT);
            CREATE TABLE AgLibraryFolder (id_local INTEGER PRIMARY KEY, rootFolder INTEGER, pathFromRoot TEXT);
            CREATE TABLE AgLibraryFile (id_local INTEGER PRIMARY KEY, folder INTEGER, baseName TEXT, extension TEXT);
            CREATE TABLE Adobe_images (id_local INTEGER PRIMARY KEY, rootFile INTEGER, rating REAL, captureTime TEXT);
            CREATE TABLE AgLibraryKeyword (id_local INTEGER PRIMARY KEY, name TEXT);
            CREATE TABLE AgLibraryKeywordImage (image INTEGER, tag INTEGER);
            INSERT INTO AgLibraryRootFolder VALUES (1, '/photos/');
            INSERT INTO AgLibraryFolder VALUES (1, 1, '2024/');
            INSERT INTO AgLibraryFile VALUES (1, 1, 'a', 'jpg'), (2, 1, 'b', 'raf');
            INSERT INTO Adobe_images VALUES (10, 1, 3.0, '2024-01-01T00:00:00'), (11, 2, NULL, NULL);
            INSERT INTO AgLibraryKeyword VALUES (1, 'sea'), (2, 'dog');
            INSERT INTO AgLibraryKeywordImage VALUES (10, 1), (10, 2);
            """
        )
        con.executemany("INSERT INTO AgLibraryKeyword VALUES (?, ?)", [(k, f"word {k}") for k in range(10, 200)])
    words = files.read_sqlite(spark, path, "AgLibraryKeyword", 3)
    assert words.count() == 192 and words.where("id_local = 150").first()["name"] == "word 150"
    got = {r["id"]: (r["path"], r["rating"], r["keywords"]) for r in files.foreign_catalog(spark, path).collect()}
    assert got == {10: ("/photos/2024/a.jpg", 3.0, ["dog", "sea"]), 11: ("/photos/2024/b.raf", None, [])}


def test_listing_and_sniffing(spark, tmp_path):
    for name, head in (("a.jpg", b"\xff\xd8\xff\xe0"), ("b.dat", b"RIFF\0\0\0\0WEBPVP8 "), ("c.png", b"\x89PNG\r\n\x1a\n"), ("d.txt", b"hello"), ("e.heic", b"\0\0\0\x18ftypheic")):
        (tmp_path / name).write_bytes(head + b"\0" * 20)
    found = files.list_files(spark, f"file://{tmp_path}")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.where(files.supported(F.col("path"))).collect()) == ["a.jpg", "c.png", "e.heic"]
    content = spark.read.format("binaryFile").load(f"file://{tmp_path}").select("path", files.sniff(F.col("content")).alias("kind"))
    assert {r["path"].rsplit("/", 1)[1]: r["kind"] for r in content.collect()} == {"a.jpg": "jpeg", "b.dat": "webp", "c.png": "png", "d.txt": None, "e.heic": "heif"}


def test_keyword_list(spark):
    lines = ["animals", "\tdog", "\t\t{puppy}", "\t\t{hound}", "\t[cat]", "places", "\titaly", "\t\trome"]
    rows = spark.createDataFrame([("l", k, v) for k, v in enumerate(lines)], "list string, place int, value string")
    got = {r["path"]: (r["synonyms"], r["exported"]) for r in files.parse_keyword_list(rows).collect()}
    assert got == {
        "animals": ([], True), "animals|dog": (["hound", "puppy"], True), "animals|cat": ([], False), "places": ([], True), "places|italy": ([], True), "places|italy|rome": ([], True),
    }


def test_properties_merge(spark):
    row = spark.range(1).select(
        metadata.merge_properties(F.expr("map('a', '1', 'foreign', '2')"), F.expr("map('a', '3', 'x', '4')"), ["a", "b"]).alias("m")
    ).first()
    assert row["m"] == {"foreign": "2", "a": "3"}


def test_repair_and_sessions(spark):
    albums = spark.createDataFrame([(1, None), (2, 1), (3, 99), (4, 5), (5, 4), (6, 6), (7, 2)], "id long, parent long")
    assert {r["id"]: r["parent"] for r in bulk.repair_albums(albums).collect()} == {1: None, 2: 1, 3: None, 4: None, 5: None, 6: None, 7: 2}
    shots = spark.createDataFrame([("u", i, s, f"f{i}") for i, s in enumerate([0, 2, 9, 16, 100, 3600])], "u string, id long, secs long, file_name string")
    stacks = sequences.auto_stacks(shots, ["u"], 7).collect()
    assert [r["members"] for r in stacks] == [[0, 1, 2, 3]]
    kept = sequences.thin(shots, ["u"], ["secs"], 3).collect()
    assert len(kept) == 3 and {r["id"] for r in kept} >= {0, 5}


def test_damaged_records_are_left_out(spark):
    import zlib

    good = '{"seq":1,"crc":%d,"op":{"x":1}}' % zlib.crc32(b'{"x":1}')
    lines = spark.createDataFrame([(good,), (good.replace('"x":1', '"x":2'),), (good[:-2],), ("",)], "value string")
    assert [(r["seq"], r["op"]) for r in changes.decode(lines).collect()] == [(1, '{"x":1}')]


def test_long_chains_and_deep_lists_are_whole(spark):
    chain = [(1, None), *((k, k - 1) for k in range(2, 1001)), (2001, 2003), (2002, 2001), (2003, 2002), (2004, 2001)]
    got = {r["id"]: r["parent"] for r in bulk.repair_albums(spark.createDataFrame(chain, "id long, parent long")).collect()}
    assert got == {k: p if k <= 1000 else None for k, p in chain}
    lines = [(1, k, "\t" * k + f"level {k}") for k in range(50)] + [(1, 50, "\tback")]
    got = files.parse_keyword_list(spark.createDataFrame(lines, "list long, place long, value string"))
    want = {"|".join(f"level {j}" for j in range(k + 1)) for k in range(50)} | {"level 0|back"}
    assert {r["path"] for r in got.collect()} == want
