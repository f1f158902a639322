"""Queries of albums, sources and copied metadata.

Suppliers stand for albums, every tenth of them a folder of those that follow; lines of orders put parts' numbers, which
stand for photos, into them by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith.operators import albums, catalog
from photolith.operators.filters import Filter, apply
from photolith.plans.registry import query
from photolith.sources.photos import PHOTOS_CTE, photos, read

_ALBUM = [
    ("id", "s_suppkey"),
    ("parent", "CASE WHEN s_suppkey % 10 <> 0 AND s_suppkey > 9 THEN s_suppkey - s_suppkey % 10 END"),
    ("name", "concat(CASE WHEN s_suppkey % 4 = 0 THEN 'TRIP ' ELSE 'Trip ' END, cast(s_suppkey * 37 % 11 as string))"),
    ("folder", "s_suppkey % 10 = 0"),
    ("place", "CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 7 % 10 END"),
]
_ALBUMS_CTE = "albums AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _ALBUM) + " FROM supplier)"
_MEMBERS_CTE = "members AS (SELECT l_suppkey AS album, l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS place FROM lineitem GROUP BY ALL)"
W = f"WITH {PHOTOS_CTE}, {_ALBUMS_CTE}, {_MEMBERS_CTE} "
IN_LIBRARY = "NOT deleted AND NOT local"


def _albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").selectExpr(*[f"{e} AS {n}" for n, e in _ALBUM])


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("album"), F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return rows.groupBy("album", "id").agg(F.min("place").alias("place"))


@query(W + f"SELECT id, rating, file_name FROM photos WHERE {IN_LIBRARY} AND rating >= 2 AND id IN (SELECT id FROM members WHERE album = 3)")
def filter_album(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An album as a source, with the filter bar on it."""
    chosen = _members(spark, sf_dir).where("album = 3")
    return apply(photos(spark, sf_dir), Filter(album=chosen, rating=2)).select("id", "rating", "file_name")


@query(W + f"SELECT id, place FROM photos JOIN members USING (id) WHERE {IN_LIBRARY} AND album = 3 ORDER BY place DESC, id DESC LIMIT 50 OFFSET 10")
def album_hand_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of an album in the order its photos were put into it, the last first."""
    found, keys = albums.hand_order(photos(spark, sf_dir), _members(spark, sf_dir), 3, False)
    return catalog.page(found, keys, 10, 50).select("id", "place")


@query(W + "SELECT id, parent, row_number() OVER (PARTITION BY parent ORDER BY folder DESC, place IS NULL, place, lower(name), id) AS listed FROM albums")
def album_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return albums.siblings(_albums(spark, sf_dir)).select("id", "parent", F.col("listed").cast("long").alias("listed"))


@query(W + """, sorted AS (SELECT * REPLACE (CASE WHEN parent = 10 THEN NULL ELSE place END AS place), coalesce(parent = 10 AND place IS NOT NULL, false) AS changed FROM albums)
SELECT id, parent, changed, row_number() OVER (PARTITION BY parent ORDER BY folder DESC, place IS NULL, place, lower(name), id) AS listed FROM sorted""")
def album_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder's albums sorted by name, the others as they were."""
    found = albums.siblings(albums.sort_by_name(_albums(spark, sf_dir), 10))
    return found.select("id", "parent", "changed", F.col("listed").cast("long").alias("listed"))


@query(W + f""", latest AS (SELECT max(substr(imported, 1, 10))::DATE - 30 AS d FROM photos WHERE {IN_LIBRARY})
SELECT 'all' AS source, NULL::BIGINT AS album, count(*) AS n FROM photos WHERE {IN_LIBRARY} UNION ALL SELECT 'deleted', NULL, count(*) FROM photos WHERE deleted
UNION ALL SELECT 'picks', NULL, count(*) FROM photos WHERE {IN_LIBRARY} AND flag = 'pick'
UNION ALL SELECT 'recent', NULL, count(*) FROM photos WHERE {IN_LIBRARY} AND substr(imported, 1, 10) >= (SELECT strftime(d, '%Y-%m-%d') FROM latest)
UNION ALL SELECT 'album', album, count(*) FROM members JOIN photos USING (id) WHERE {IN_LIBRARY} GROUP BY album""")
def source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return albums.source_totals(photos(spark, sf_dir), _members(spark, sf_dir))


#: All that is copied but the whole text of the caption.
_PASTED = [c for c in albums.COPIED if c != "caption"]


@query(W + ", first AS (SELECT * FROM photos WHERE id = (SELECT min(id) FROM photos WHERE id > 20)) SELECT p.id, "
       + ", ".join(f"CASE WHEN p.is_cropped THEN f.{c} ELSE p.{c} END AS {c}" for c in _PASTED) + " FROM photos p CROSS JOIN first f WHERE NOT p.deleted AND NOT p.local")
def metadata_pasted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One photo's metadata, copied to all cropped ones."""
    rows = photos(spark, sf_dir)
    source = rows.where("id > 20").agg(F.min("id")).first()[0]
    return albums.paste_metadata(rows, source, F.col("is_cropped"), _PASTED).where("not deleted and not local").select("id", *_PASTED)
