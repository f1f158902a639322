"""Queries that put a library right: pairs of files, repair, partial settings, faces and what is learned from edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith.operators import evaluation, faces, models, pairing, settings
from photolith.operators import repair as mending
from photolith.plans.events import shared_folder
from photolith.plans.registry import query
from photolith.sources.photos import read, stream
from photolith.streaming import faces as face_stream

#: Files of shots: stems that many folders share, exports one folder inside, some with another time, camera or size.
_FILES = [
    ("id", "doc_id"),
    ("folder", "concat('/shots/', lang, CASE WHEN doc_id % 3 = 1 THEN '/export' WHEN doc_id % 17 = 5 THEN '/a/b' ELSE '' END)"),
    ("stem", "concat('IMG_', cast(doc_id % 480 - doc_id % 12 AS string))"),
    ("ending", "CASE WHEN doc_id % 4 = 0 THEN '.RAF' WHEN doc_id % 4 = 2 AND doc_id % 5 = 0 THEN '.dng' WHEN doc_id % 29 = 1 THEN '.png' ELSE '.JPG' END"),
    ("captured", "CASE WHEN doc_id % 19 <> 2 THEN concat('2024-01-01T10:', cast(doc_id % 36 - doc_id % 12 AS string)) END"),
    ("camera", "CASE WHEN doc_id % 7 = 3 THEN '' WHEN doc_id % 11 = 4 THEN 'Cam B' ELSE 'Cam A' END"),
    ("width", "CASE WHEN doc_id % 13 = 6 THEN 0 ELSE 6000 - 500 * (doc_id % 2) END"),
]


_PATH = [("path", "concat(folder, '/', stem, ending)"), ("kind", "CASE WHEN ending IN ('.RAF', '.dng') THEN 'raw' ELSE 'image' END"), ("height", "width")]
_columns = lambda told: ", ".join(f"{e} AS {n}" for n, e in told)


@query(f"""WITH f AS (SELECT *, {_columns(_PATH)} FROM (SELECT {_columns(_FILES)} FROM documents)), p AS (SELECT j.id AS jpeg_id, r.id AS raw_id, r.path, CASE WHEN r.folder = j.folder THEN 'sameFolder' ELSE 'directExport' END AS relation
FROM f r JOIN f j ON r.kind = 'raw' AND j.ending = '.JPG' AND r.stem = j.stem AND r.captured = j.captured AND (r.camera = '' OR j.camera = '' OR r.camera = j.camera)
AND (r.folder = j.folder OR (r.folder = regexp_replace(j.folder, '/[^/]*$', '') AND ((r.camera <> '' AND j.camera <> '') OR (r.width > 0 AND r.width = j.width AND r.height = j.height)))))
SELECT jpeg_id, arg_min(raw_id, (path, raw_id)) AS raw_id, arg_min(relation, (path, raw_id)) AS relation FROM p GROUP BY jpeg_id""")
def raw_jpeg_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each JPEG with the RAW of its shot, in the same folder or in the one around it."""
    files = read(spark, sf_dir, "documents").selectExpr(*[f"{e} AS {n}" for n, e in _FILES]).selectExpr("*", *[f"{e} AS {n}" for n, e in _PATH])
    return pairing.raw_jpeg_relations(files)


_PARENT = "CASE s_suppkey % 10 WHEN 0 THEN NULL WHEN 1 THEN s_suppkey + 1 WHEN 2 THEN s_suppkey - 1 WHEN 3 THEN s_suppkey + 6 WHEN 4 THEN -1 WHEN 5 THEN s_suppkey - 2 WHEN 6 THEN s_suppkey + 3 WHEN 7 THEN s_suppkey + 1 WHEN 8 THEN s_suppkey - 1 ELSE s_suppkey - 5 END"


def _catalog(spark: SparkSession, sf_dir: str) -> mending.Catalog:
    """Documents as photos, suppliers as albums, orders as stacks of their parts; counters that lag behind."""
    photos = read(spark, sf_dir, "documents").selectExpr("doc_id AS filed", "CASE WHEN doc_id % 50 = 7 THEN doc_id + 1 ELSE doc_id END AS id")
    albums = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS filed", "s_suppkey AS id", f"{_PARENT} AS parent", "s_suppkey % 10 <> 8 AS folder")
    stacks = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS filed", "CASE WHEN o_orderkey % 1000 = 3 THEN -o_orderkey ELSE o_orderkey END AS id")
    members = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS stack", "l_linenumber AS pos", "l_partkey * 7 % 1999 AS photo")
    counters = spark.createDataFrame([("photo", 5), ("album", 1 << 40), ("stack", 5)], "kind string, next long")
    return mending.Catalog(photos, albums, stacks, members, counters)


@query(f"""WITH RECURSIVE albums AS (SELECT s_suppkey AS id, {_PARENT} AS parent, s_suppkey % 10 <> 8 AS folder FROM supplier),
walk AS (SELECT id, parent AS at, 1 AS steps FROM albums WHERE parent IS NOT NULL UNION ALL SELECT w.id, a.parent, steps + 1 FROM walk w JOIN albums a ON a.id = w.at AND a.folder WHERE a.parent IS NOT NULL AND steps < 40),
ways AS (SELECT w.id, min(a.id) AS low, bool_or(a.id IS NULL) OR max(steps) = 40 AS broken FROM walk w LEFT JOIN albums a ON a.id = w.at AND a.folder GROUP BY w.id),
moved AS (SELECT id FROM ways WHERE broken AND (low IS NULL OR id <= low)),
m AS (SELECT l_orderkey AS stack, l_linenumber AS pos, l_partkey * 7 % 1999 AS photo FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
once AS (SELECT stack, photo, min(pos) AS pos, photo IN (SELECT doc_id FROM documents) AS here FROM m GROUP BY stack, photo),
kept AS (SELECT o_orderkey AS id, coalesce(count(*) FILTER (here), 0) AS kept, (SELECT count(*) FROM m WHERE m.stack = o_orderkey) - coalesce(count(*) FILTER (here), 0) AS out FROM orders LEFT JOIN once ON stack = o_orderkey GROUP BY o_orderkey),
stay AS (SELECT photo, min(stack) AS stack, arg_min(pos, stack) AS pos FROM once WHERE here AND stack IN (SELECT id FROM kept WHERE kept >= 2) GROUP BY photo),
again AS (SELECT id, kept, count(photo) AS n FROM kept LEFT JOIN stay ON stack = id WHERE kept >= 2 GROUP BY id, kept),
last AS (SELECT id FROM again WHERE n >= 2),
past AS (SELECT 'photo' AS kind, max(doc_id) + 1 AS past, 5 AS next FROM documents UNION ALL SELECT 'album', max(id) + 1, {1 << 40} FROM albums UNION ALL SELECT 'stack', coalesce(max(id), 0) + 1, 5 FROM last)
SELECT 'album' AS part, id, CASE WHEN id NOT IN (SELECT id FROM moved) THEN parent END AS n, '' AS what FROM albums
UNION ALL SELECT 'member', stack, photo, pos::VARCHAR FROM stay WHERE stack IN (SELECT id FROM last) UNION ALL SELECT 'stack', id, NULL, '' FROM last
UNION ALL SELECT 'counter', NULL, greatest(past, next), kind FROM past
UNION ALL SELECT 'change photo', doc_id, 1, 'filed as another id' FROM documents WHERE doc_id % 50 = 7
UNION ALL SELECT 'change stack', o_orderkey, 1, 'filed as another id' FROM orders WHERE o_orderkey % 1000 = 3
UNION ALL SELECT 'change stack', id, out, 'missing or repeated photos left out' FROM kept WHERE out > 0
UNION ALL SELECT 'change stack', id, kept, 'fewer than two photos: removed' FROM kept WHERE kept < 2
UNION ALL SELECT 'change stack', id, kept - n, 'photos in another stack left out' FROM again WHERE kept > n
UNION ALL SELECT 'change album', a.id, a.parent, 'moved to the top' FROM albums a JOIN moved USING (id)
UNION ALL SELECT 'change counter', NULL, past, kind || ' ids passed' FROM past WHERE past > next""")
def repair_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired tables and the list of changes, one below the other."""
    mended, changes = mending.repair(_catalog(spark, sf_dir))
    part = lambda rows, name, i, n, what="''": rows.selectExpr(f"'{name}' AS part", f"cast({i} AS long) AS id", f"cast({n} AS long) AS n", f"cast({what} AS string) AS what")
    found = part(mended.albums, "album", "id", "parent").unionAll(part(mended.members, "member", "stack", "photo", "pos"))
    found = found.unionAll(part(mended.stacks, "stack", "id", "NULL")).unionAll(part(mended.counters, "counter", "NULL", "next", "kind"))
    return found.unionAll(changes.select(F.concat(F.lit("change "), F.col("kind")).alias("part"), "id", "n", "what"))


_PATCH = """CASE event_id % 5 WHEN 0 THEN concat('{"light":{"exposure":', cast(event_id % 90 AS string), ',"curve":{"mid":', cast(event_id % 7 AS string), '}}}')
WHEN 1 THEN concat('{"light":{"curve":{"low":', cast(event_id % 11 AS string), '}},"mode":"', event_type, '"}') WHEN 2 THEN concat('{"mode":{"name":"', event_type, '","n":', cast(event_id % 3 AS string), '}}')
WHEN 3 THEN props ELSE CASE WHEN event_id % 4 = 0 THEN '{"light":{"curve":3}}' ELSE '{"crop":{},"tags":[1,2]}' END END"""
_PATHS = {"exposure": "light.exposure", "curve": "light.curve", "mid": "light.curve.mid", "low": "light.curve.low", "mode": "mode", "name": "mode.name", "n": "mode.n", "k": "k", "tags": "tags"}


@query(f"""WITH s AS (SELECT user_id AS key, list_reduce(list(({_PATCH})::JSON ORDER BY event_id), lambda a, b: json_merge_patch(a, b)) AS j FROM events GROUP BY user_id)
SELECT key, {', '.join(f"CASE WHEN json_type(j, '$.{p}') = 'OBJECT' THEN 'object' ELSE json_extract_string(j, '$.{p}') END AS {c}" for c, p in _PATHS.items())} FROM s""")
def settings_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's partial settings, merged in the order of the events."""
    patches = read(spark, sf_dir, "events").selectExpr("user_id AS key", "event_id AS seq", f"{_PATCH} AS patch")
    at = lambda p: F.get_json_object("settings", f"$.{p}")
    return settings.deep_merge(patches).select("key", *[F.when(F.startswith(at(p), F.lit("{")), "object").otherwise(at(p)).alias(c) for c, p in _PATHS.items()])


_BOXES = "SELECT floor(vec_id / 3)::BIGINT AS photo, vec_id AS id, x AS x0, y AS y0, x + 0.5 AS x1, y + 0.4 AS y1 FROM (SELECT vec_id, {x} AS x, {y} AS y FROM embeddings)"
_REGIONS = _BOXES.format(x="embedding[1]::DOUBLE", y="embedding[2]::DOUBLE")
_FOUND = _BOXES.format(x="embedding[1]::DOUBLE + embedding[3]::DOUBLE / 2", y="embedding[2]::DOUBLE + embedding[4]::DOUBLE / 2")
_PAIRS = f"""r AS ({_REGIONS}), d AS ({_FOUND}), o AS (SELECT r.photo, r.id AS region, d.id AS detection, greatest(0, least(r.x1, d.x1) - greatest(r.x0, d.x0)) * greatest(0, least(r.y1, d.y1) - greatest(r.y0, d.y0)) AS common,
(r.x1 - r.x0) * (r.y1 - r.y0) + (d.x1 - d.x0) * (d.y1 - d.y0) AS areas FROM r JOIN d USING (photo)), p AS (SELECT photo, region, detection, round(common / (areas - common), 9) AS iou FROM o WHERE round(common / (areas - common), 9) >= 0.3)"""


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = [F.col("embedding")[k].cast("double") for k in range(4)]
    rows = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 3).cast("long").alias("photo"), F.col("vec_id").alias("id"), e[0].alias("x"), e[1].alias("y"), (e[2] / 2).alias("dx"), (e[3] / 2).alias("dy"))
    box = lambda x, y: rows.select("photo", "id", x.alias("x0"), y.alias("y0"), (x + 0.5).alias("x1"), (y + 0.4).alias("y1"))
    x, y = F.col("x"), F.col("y")
    return box(x, y), box(x + F.col("dx"), y + F.col("dy"))


@query(f"WITH {_PAIRS} SELECT photo, region, arg_min(detection, (-iou, detection)) AS detection, max(iou) AS iou FROM p GROUP BY photo, region")
def face_regions_lent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each region of a photo the detection that overlaps it most."""
    return faces.lend_landmarks(*_boxes(spark, sf_dir))


@query(f"""WITH {_PAIRS}, g AS (SELECT photo, list_reduce(list_prepend({{'i': 0.0::DOUBLE, 'r': -1::BIGINT, 'd': -1::BIGINT, 'rs': []::BIGINT[], 'ds': []::BIGINT[]}},
list({{'i': -iou, 'r': region, 'd': detection, 'rs': []::BIGINT[], 'ds': []::BIGINT[]}} ORDER BY -iou, region, detection)), lambda a, b: CASE WHEN list_contains(a.rs, b.r) OR list_contains(a.ds, b.d) THEN a
ELSE {{'i': b.i, 'r': b.r, 'd': b.d, 'rs': list_append(a.rs, b.r), 'ds': list_append(a.ds, b.d)}} END) AS a FROM p GROUP BY photo), u AS (SELECT photo, unnest(a.rs) AS region, unnest(a.ds) AS detection FROM g)
SELECT photo, region, detection, iou FROM u JOIN p USING (photo, region, detection)""")
def face_regions_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and detections of a photo, one to one by descending overlap."""
    return faces.match_regions(*_boxes(spark, sf_dir))


_POINTS = "SELECT vec_id, unnest([1, 2, 3, 4, 5]) AS k, embedding FROM embeddings"


@query(f"""WITH p AS (SELECT vec_id, CASE WHEN vec_id % 50 = 3 THEN 1.0 ELSE embedding[2 * k - 1]::DOUBLE END AS px, CASE WHEN vec_id % 50 = 3 THEN 2.0 ELSE embedding[2 * k]::DOUBLE END AS py,
embedding[2 * k]::DOUBLE * 30 + embedding[k + 20]::DOUBLE + 56 AS qx, embedding[2 * k - 1]::DOUBLE * -30 + embedding[k + 30]::DOUBLE + 60 AS qy FROM ({_POINTS})),
s AS (SELECT vec_id, avg(px) AS mx, avg(py) AS my, avg(qx) AS nx, avg(qy) AS ny, covar_pop(px, qx) + covar_pop(py, qy) AS a, covar_pop(px, qy) - covar_pop(py, qx) AS b, var_pop(px) + var_pop(py) AS norm FROM p GROUP BY vec_id),
f AS (SELECT *, CASE WHEN norm * 5 > 1e-9 THEN a / norm END AS re, CASE WHEN norm * 5 > 1e-9 THEN b / norm END AS im FROM s)
SELECT vec_id, round(re, 6) AS re, round(im, 6) AS im, round(nx - (re * mx - im * my), 6) AS tx, round(ny - (re * my + im * mx), 6) AS ty FROM f""")
def face_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform that takes five points of each face to where they belong; those all at one place have none."""
    e, k, one = F.col("embedding"), F.col("k"), F.col("vec_id") % 50 == 3
    at = lambda i: F.element_at(e, i.cast("int")).cast("double")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    points = rows.select(
        "vec_id", F.when(one, 1.0).otherwise(at(2 * k - 1)).alias("px"), F.when(one, 2.0).otherwise(at(2 * k)).alias("py"),
        (at(2 * k) * 30 + at(k + 20) + 56).alias("qx"), (at(2 * k - 1) * -30 + at(k + 30) + 60).alias("qy"),
    )
    return faces.fit_similarity(points, "vec_id").select("vec_id", *[F.round(c, 6).alias(c) for c in ("re", "im", "tx", "ty")])


_SCANS = "SELECT vec_id // 4 AS photo, CASE WHEN vec_id % 9 = 4 THEN 2 ELSE 1 END AS version, CASE WHEN vec_id % 21 <> 2 THEN vec_id % 3 + round(embedding[1]::DOUBLE, 1) END AS x0 FROM embeddings"


@query(f"""WITH s AS ({_SCANS}), l AS (SELECT *, max(version) OVER (PARTITION BY photo) AS last FROM s)
SELECT DISTINCT photo, version::BIGINT AS version, concat_ws(',', round(x0 * 10000)::BIGINT, 2000, round((x0 + 0.5) * 10000)::BIGINT, 6000) AS key FROM l WHERE version = last AND x0 IS NOT NULL""")
def face_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after a stream of scans: each face once, none of an older version of its photo."""
    x = F.when(F.col("vec_id") % 21 != 2, F.col("vec_id") % 3 + F.round(F.col("embedding")[0].cast("double"), 1))
    scans = stream(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 4).cast("long").alias("photo"), F.when(F.col("vec_id") % 9 == 4, 2).otherwise(1).cast("long").alias("version"),
        x.alias("x0"), F.lit(0.2).alias("y0"), (x + 0.5).alias("x1"), F.lit(0.6).alias("y1"), "embedding",
    )
    return face_stream.run_index(scans, spark, shared_folder(spark)).select("photo", "version", "key")


@query()
def ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a line's price its quantity, discount, tax and number say, weighted by quantity; held against loops over the
    rows in the tests."""
    rows = read(spark, sf_dir, "lineitem").selectExpr(
        "l_quantity / 50 AS quantity", "l_discount * 10 AS discount", "l_tax * 10 AS tax", "l_linenumber / 7 AS line", "l_extendedprice / 10000 AS price", "1 + l_quantity / 50 AS weight"
    )
    found = models.fit_ridge(rows, ["quantity", "discount", "tax", "line"], "price", "weight")
    return spark.createDataFrame([(term, round(c, 9)) for term, c in found.items()], "term string, coefficient double")


@query("""WITH f AS (SELECT doc_id % 3 AS split, floor(doc_id / 4)::BIGINT AS burst, coalesce(quality = 1 AND doc_id % 2 = 0, false) AS fine, CASE doc_id % 6 WHEN 0 THEN 'reject' WHEN 5 THEN 'abstain' ELSE 'keep' END AS said,
CASE WHEN quality = 0 THEN 'reject' WHEN quality = 1 AND doc_id % 2 = 0 OR quality = 1 THEN 'keep' END AS truth, doc_id % 4 = floor(doc_id / 4)::BIGINT % 4 AND doc_id % 6 <> 5 AS won FROM documents LEFT JOIN labels USING (doc_id)),
b AS (SELECT split, burst, bool_or(fine) AS counts, bool_or(fine AND won) AS r, bool_or(won) AS c FROM f GROUP BY split, burst), w AS (SELECT split, count(*) AS n, count(*) FILTER (r) AS r, count(*) FILTER (c) AS c FROM b WHERE counts GROUP BY split),
t AS (SELECT split, count(*) AS photos, count(truth) AS labelled, count(*) FILTER (truth IS NULL AND said = 'reject') AS unknown_rejects, count(*) FILTER (truth IS NOT NULL AND said <> 'abstain') AS decided,
count(*) FILTER (truth = 'keep') AS k, count(*) FILTER (truth = 'keep' AND said = 'keep') AS kk, count(*) FILTER (truth = 'keep' AND said = 'reject') AS kr,
count(*) FILTER (truth = 'reject') AS r, count(*) FILTER (truth = 'reject' AND said = 'keep') AS rk, count(*) FILTER (truth = 'reject' AND said = 'reject') AS rr FROM f GROUP BY split)
SELECT split, photos, labelled, kr AS false_rejects, unknown_rejects, coalesce(n, 0) AS bursts, round(kk / nullif(kk + rk, 0), 6) AS precision, round(kk / nullif(k, 0), 6) AS recall, round(rr / nullif(rr + kr, 0), 6) AS reject_precision,
round(rr / nullif(t.r, 0), 6) AS reject_recall, round(kr / nullif(k, 0), 6) AS false_reject_rate, round(decided / nullif(labelled, 0), 6) AS decision_coverage, round(w.r / nullif(n, 0), 6) AS winner_agreement, round(c / nullif(n, 0), 6) AS winner_coverage
FROM t LEFT JOIN w USING (split)""")
def cull_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions and winners of a cull against labels, per split."""
    i = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    fine = F.coalesce((F.col("quality") == 1) & (i % 2 == 0), F.lit(False))
    label = F.when(F.col("quality") == 1, "keep").when(F.col("quality") == 0, "reject")
    frames = docs.select(i.alias("id"), (i % 3).alias("split"), F.floor(i / 4).cast("long").alias("burst"), label.alias("label"), fine.alias("acceptable"))
    said = docs.where(i % 6 != 5).select(i.alias("id"), F.when(i % 6 == 0, "reject").otherwise("keep").alias("decision"), (i % 4 == F.floor(i / 4) % 4).alias("winner"))
    return evaluation.cull_report(frames, said)
