"""Queries of set operations, bulk edits, evaluation and image measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith.functions import pixels
from photolith.functions.names import people
from photolith.operators import bulk, keywords, rules
from photolith.plans.registry import query
from photolith.sources.photos import PHOTOS_CTE, photos, read, visible

W = f"WITH {PHOTOS_CTE} "
IN_LIBRARY = "NOT deleted AND NOT local"


@query(W + f"""(SELECT id FROM photos WHERE {IN_LIBRARY} AND rating >= 3 EXCEPT SELECT id FROM photos WHERE {IN_LIBRARY} AND flag = 'pick')
UNION ALL (SELECT id FROM photos WHERE {IN_LIBRARY} AND flag = 'pick' EXCEPT SELECT id FROM photos WHERE {IN_LIBRARY} AND rating >= 3)""")
def selection_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = visible(photos(spark, sf_dir))
    return bulk.toggle(shown.where("rating >= 3"), shown.where("flag = 'pick'"))


@query(W + f"""SELECT label, id, place FROM (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY lower(file_name), id) AS place FROM photos WHERE {IN_LIBRARY}) WHERE place BETWEEN 3 AND 7""")
def selection_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = visible(photos(spark, sf_dir)).select("label", "id", F.lower("file_name").alias("name"))
    return bulk.select_range(listed, ["name", "id"], ["label"], 7, 3).select("label", "id", F.col("place").cast("long").alias("place"))


@query(W + f"""SELECT id FROM photos WHERE {IN_LIBRARY} AND flag = 'pick' AND rating <= 3 AND label IS NULL UNION SELECT id FROM photos WHERE {IN_LIBRARY} AND rating = 5""")
def selection_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos without a label among the picks of up to three stars, added to a selection of those with five."""
    shown = visible(photos(spark, sf_dir))
    return bulk.select_by(shown, "pick", 3, "lte", "none", add_to=bulk.select_by(shown, rating=9, rating_op="eq"))


@query("""WITH s AS (SELECT conv_id, list(turn ORDER BY turn) AS m FROM conversations GROUP BY conv_id)
SELECT conv_id, list_filter(m, lambda t: t NOT IN (1, 3)) AS kept, CASE WHEN len(m[:2]) >= 2 THEN m[:2] END AS head, CASE WHEN len(m[3:]) >= 2 THEN m[3:] END AS tail,
list_concat(m, list_filter([100, 1, 200], lambda t: NOT list_contains(m, t))) AS merged FROM s""")
def stack_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = F.sort_array(F.collect_list("turn")).alias("m")
    stacks = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(members)
    m, longs = F.col("m"), lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    head, tail = bulk.split_stack(m, 3)
    return stacks.select("conv_id", bulk.without(m, longs(1, 3)).alias("kept"), head.alias("head"), tail.alias("tail"), bulk.merge_stacks(m, longs(100, 1, 200)).alias("merged"))


@query("""SELECT stack_id, id, row_number() OVER (PARTITION BY stack_id ORDER BY turn) AS pos FROM (SELECT conv_id AS stack_id, conv_id * 10 + turn AS id, turn, count(*) OVER (PARTITION BY conv_id) AS n
FROM conversations WHERE (conv_id * 10 + turn) NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)) WHERE n >= 2""")
def stack_members_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks after a permanent delete."""
    stacks = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stack_id"), (F.col("conv_id") * 10 + F.col("turn")).alias("id"), F.col("turn").alias("pos"))
    gone = read(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"))
    return bulk.drop_members(stacks, gone).select("stack_id", "id", F.col("pos").cast("long").alias("pos"))


@query(W + """, m AS (SELECT id, lower(file_name) AS name, file_size AS size, content_hash AS hash FROM photos WHERE id % 2 = 0),
f AS (SELECT id AS fid, lower(file_name) AS name, file_size AS size, content_hash AS hash FROM photos WHERE id % 2 = 1),
p1 AS (SELECT a.id, b.fid, 'same' AS how FROM (SELECT *, row_number() OVER (PARTITION BY name, size, hash ORDER BY id) AS k FROM m) a JOIN (SELECT *, row_number() OVER (PARTITION BY name, size, hash ORDER BY fid) AS k FROM f) b USING (name, size, hash, k)),
m2 AS (SELECT * FROM m WHERE id NOT IN (SELECT id FROM p1)), f2 AS (SELECT * FROM f WHERE fid NOT IN (SELECT fid FROM p1)),
p2 AS (SELECT a.id, b.fid, 'renamed' AS how FROM (SELECT *, row_number() OVER (PARTITION BY size, hash ORDER BY id) AS k FROM m2) a JOIN (SELECT *, row_number() OVER (PARTITION BY size, hash ORDER BY fid) AS k FROM f2) b USING (size, hash, k)),
m3 AS (SELECT * FROM m2 WHERE id NOT IN (SELECT id FROM p2)), f3 AS (SELECT name, size, min(fid) AS fid FROM f2 WHERE fid NOT IN (SELECT fid FROM p2) GROUP BY name, size HAVING count(*) = 1),
p3 AS (SELECT min(id) AS id, fid, 'name' AS how FROM m3 JOIN f3 USING (name, size) GROUP BY fid)
SELECT id, fid AS found_id, how FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3""")
def find_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir).select("id", F.col("file_name").alias("name"), F.col("file_size").alias("size"), F.col("content_hash").alias("hash"))
    return bulk.find_missing(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))


@query("""SELECT split, n, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fn / nullif(fn + tp, 0), 6) AS false_reject, round((tp + tn) / n, 6) AS accuracy FROM (
SELECT doc_id % 3 AS split, count(*) AS n, count(*) FILTER (p AND quality = 1) AS tp, count(*) FILTER (p AND quality = 0) AS fp, count(*) FILTER (NOT p AND quality = 1) AS fn, count(*) FILTER (NOT p AND quality = 0) AS tn
FROM (SELECT *, doc_id % 5 <> 0 AS p FROM labels) GROUP BY split)""")
def cull_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bulk.rates(read(spark, sf_dir, "labels").withColumn("split", F.col("doc_id") % 3), ["split"], F.col("doc_id") % 5 != 0, F.col("quality") == 1)


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 IN (1, 2) THEN NULL WHEN s_suppkey % 10 = 3 THEN NULL WHEN s_suppkey % 10 = 4 THEN NULL ELSE s_suppkey - 1 END AS parent FROM supplier WHERE s_suppkey % 10 <> 0""")
def repair_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each ten: 1 and 2 name each other, 3 hangs below them, 4's parent is gone, 5 to 9 are a chain."""
    k = F.col("s_suppkey")
    last = k % 10
    parent = F.when(last == 1, k + 1).when(last == 2, k - 1).when(last == 3, k - 1).when(last == 4, F.lit(-1)).otherwise(k - 1)
    return bulk.repair_albums(read(spark, sf_dir, "supplier").where(last != 0).select(k.alias("id"), parent.alias("parent")))


@query("""SELECT coalesce(a.path, b.path) AS path, list_sort(list_distinct(list_filter([a.syn, b.syn], lambda x: x IS NOT NULL))) AS synonyms FROM
(SELECT DISTINCT p_brand AS path, lower(p_brand) AS key, 'ours' AS syn FROM part WHERE p_partkey % 2 = 0) a FULL JOIN (SELECT DISTINCT upper(p_brand) AS path, lower(p_brand) AS key, 'theirs' AS syn FROM part WHERE p_partkey % 3 = 0) b USING (key)""")
def keyword_list_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    ours = part.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("path"), F.array(F.lit("ours")).alias("synonyms")).distinct()
    theirs = part.where("p_partkey % 3 = 0").select(F.upper("p_brand").alias("path"), F.array(F.lit("theirs")).alias("synonyms")).distinct()
    return keywords.union_lists(ours, theirs).select("path", F.sort_array("synonyms").alias("synonyms"))


_V = "list_transform(embedding, lambda x: x::DOUBLE)"


@query(f"""SELECT vec_id, round((v[1] - m) / len, 9) AS s0, round(list_aggregate(list_transform([{', '.join(f'v[{k + 1}] - (v[{k}] + v[{k + 2}] + v[{k - 7}] + v[{k + 9}]) / 4' for k in (r * 8 + c for r in range(1, 7) for c in range(1, 7)))}], lambda d: d * d), 'sum') / 36, 9) AS energy,
len(list_filter(embedding, lambda x: x <= -0.2 OR x >= 0.2)) / 64 AS clipped FROM (SELECT vec_id, embedding, v, list_avg(v) AS m, sqrt(list_sum(list_transform(v, lambda x: (x - list_avg(v)) * (x - list_avg(v))))) AS len FROM (SELECT vec_id, embedding, {_V} AS v FROM embeddings))""")
def image_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector as an 8 x 8 image: signature, sharpness, clipping."""
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(pixels.signature(e)[0], 9).alias("s0"), F.round(pixels.laplacian_energy(e, 8), 9).alias("energy"), pixels.clipped(e, -0.2, 0.2).alias("clipped")
    )


@query("""SELECT vec_id, round(0.2104542553 * l + 0.7936177850 * m - 0.0040720468 * s, 9) AS ok_l FROM (SELECT vec_id, cbrt(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b) AS l, cbrt(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b) AS m,
cbrt(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b) AS s FROM (SELECT vec_id, abs(embedding[1]::DOUBLE) AS r, abs(embedding[2]::DOUBLE) AS g, abs(embedding[3]::DOUBLE) AS b FROM embeddings))""")
def colour_oklab(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = (F.abs(F.col("embedding")[k].cast("double")) for k in range(3))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(pixels.oklab(r, g, b)[0], 9).alias("ok_l"))


@query("""SELECT vec_id, round(60 * CASE WHEN d = 0 THEN 0 WHEN mx = r THEN CASE WHEN g < b THEN (g - b) / d + 6 ELSE (g - b) / d END WHEN mx = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END, 6) AS hue,
round(CASE WHEN mx > 0 THEN d / mx ELSE 0 END, 6) AS s_hsv, round(mx, 6) AS v, round(CASE WHEN 1 - abs(mx + mn - 1) > 0 THEN d / (1 - abs(mx + mn - 1)) ELSE 0 END, 6) AS s_hsl, round((mx + mn) / 2, 6) AS l
FROM (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn, greatest(r, g, b) - least(r, g, b) AS d FROM
(SELECT vec_id, least(1, abs(embedding[1]::DOUBLE)) AS r, least(1, abs(embedding[2]::DOUBLE)) AS g, least(1, abs(embedding[3]::DOUBLE)) AS b FROM embeddings))""")
def colour_hsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hue, saturation, value and lightness of a vector's first three numbers."""
    r, g, b = (F.least(F.lit(1.0), F.abs(F.col("embedding")[k].cast("double"))) for k in range(3))
    hue, s_hsv, v = pixels.hsv(r, g, b)
    _, s_hsl, light = pixels.hsl(r, g, b)
    found = {"hue": hue, "s_hsv": s_hsv, "v": v, "s_hsl": s_hsl, "l": light}
    return read(spark, sf_dir, "embeddings").select("vec_id", *[F.round(c, 6).alias(n) for n, c in found.items()])


@query(W + f"""SELECT id, file_name, rating, flag, coalesce(label, '') AS label, captured, camera, len(keywords)::BIGINT AS n_keywords, a.n AS albums FROM photos
LEFT JOIN (SELECT conv_id AS id, count(*) AS n FROM conversations GROUP BY conv_id) a USING (id) WHERE {IN_LIBRARY}""")
def photo_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A photo's summary with its albums."""
    albums = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("albums"))
    rows = visible(photos(spark, sf_dir)).join(albums, "id", "left")
    return rows.select("id", "file_name", "rating", "flag", F.coalesce("label", F.lit("")).alias("label"), "captured", "camera", F.size("keywords").cast("long").alias("n_keywords"), "albums")


@query(W + """SELECT a.id, coalesce(a.caption, b.caption) AS caption, coalesce(a.edited, b.imported) AS edited FROM photos a LEFT JOIN photos b ON b.id = a.id""")
def metadata_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photolith.sources.metadata import fill_missing

    rows = photos(spark, sf_dir)
    return fill_missing(rows.select("id", "caption", "edited"), rows.select("id", F.col("imported").alias("edited"), "caption"), "id")


@query(W + f"""SELECT id, unnest(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)) AS name FROM
(SELECT id, list_filter(list_transform(names, lambda n: trim(n)), lambda n: n <> '') AS l FROM photos WHERE {IN_LIBRARY})""")
def named_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible(photos(spark, sf_dir)).select("id", F.explode(people(F.col("names"))).alias("name"))


@query(W + f"""SELECT p.id, vec_id AS face FROM embeddings e JOIN photos p ON p.id = vec_id - vec_id % 3 WHERE {IN_LIBRARY} AND vec_id % 3 >= len(list_distinct(list_filter(list_transform(names, lambda n: lower(trim(n))), lambda n: n <> '')))""")
def unnamed_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces without a name on photos of the library; a photo's first faces have its names."""
    shown = visible(photos(spark, sf_dir)).select("id", F.size(people(F.col("names"))).alias("n"))
    faces = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("face"), (F.col("vec_id") - F.col("vec_id") % 3).alias("id"), (F.col("vec_id") % 3).alias("at"))
    return faces.join(shown, "id").where("at >= n").select("id", "face")


@query(W + f"""SELECT coalesce(CASE WHEN abs(w - h) <= 0.01 * greatest(w, h) THEN 'square' WHEN w > h THEN 'landscape' ELSE 'portrait' END, 'none') AS aspect, count(*) AS n, sum(file_size)::BIGINT AS bytes FROM
(SELECT CASE WHEN swapped THEN height ELSE width END AS w, CASE WHEN swapped THEN width ELSE height END AS h, file_size FROM photos WHERE {IN_LIBRARY}) GROUP BY aspect""")
def aspect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = visible(photos(spark, sf_dir))
    return shown.groupBy(F.coalesce(rules.aspect(), F.lit("none")).alias("aspect")).agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))
