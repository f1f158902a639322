"""Queries that count, group and order the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photolith.functions import times
from photolith.functions.names import is_under
from photolith.operators import catalog, keywords, sequences
from photolith.operators.numbering import numbered
from photolith.plans.registry import query
from photolith.sources.photos import FOLDERS_CTE, PHOTOS_CTE, folders, photos, read, visible

W = f"WITH {PHOTOS_CTE} "
IN_LIBRARY = "NOT deleted AND NOT local"


@query(W + f"""SELECT count(*) FILTER ({IN_LIBRARY}) AS photos, count(*) FILTER ({IN_LIBRARY} AND is_edited) AS edited, count(*) FILTER ({IN_LIBRARY} AND flag = 'pick') AS picks,
count(*) FILTER ({IN_LIBRARY} AND flag = 'reject') AS rejects, count(*) FILTER (deleted) AS deleted, (SELECT count(DISTINCT conv_id) FROM conversations) AS albums FROM photos""")
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    albums = read(spark, sf_dir, "conversations").agg(F.count_distinct("conv_id")).scalar()
    return catalog.stats(photos(spark, sf_dir), albums)


@query(W + f"""SELECT y AS year, m AS month, d AS day, count(*) AS n FROM (SELECT substr(captured, 1, 4) AS y, substr(captured, 6, 2) AS m, substr(captured, 9, 2) AS d
FROM photos WHERE {IN_LIBRARY} AND captured IS NOT NULL) GROUP BY ROLLUP (y, m, d) HAVING y IS NOT NULL""")
def date_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.date_groups(visible(photos(spark, sf_dir)))


@query("""SELECT substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS year, substr(CAST(o_orderdate AS VARCHAR), 6, 2) AS month, substr(CAST(o_orderdate AS VARCHAR), 9, 2) AS day, count(*) AS n
FROM orders GROUP BY ROLLUP (year, month, day) HAVING year IS NOT NULL""")
def date_groups_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.date_groups(read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("captured")))


@query(W + f"SELECT keyword, count(*) AS n FROM (SELECT unnest(keywords) AS keyword FROM photos WHERE {IN_LIBRARY}) GROUP BY keyword")
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.keyword_counts(visible(photos(spark, sf_dir)))


_PART_PATHS = "SELECT p_partkey AS id, unnest([lower(p_type) || '|' || replace(p_name, ' ', '|'), p_brand]) AS keyword FROM part"


@query(f"""WITH rows AS ({_PART_PATHS}), parts AS (SELECT id, string_split(keyword, '|') AS p FROM rows),
levels AS (SELECT DISTINCT id, array_to_string(p[1:k], '|') AS path FROM (SELECT id, p, unnest(range(1, len(p) + 1)) AS k FROM parts)),
per AS (SELECT lower(path) AS level, id, min(path) AS path FROM levels GROUP BY ALL)
SELECT level, arg_min(path, (id, path)) AS path, count(*) AS n FROM per GROUP BY level""")
def keyword_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.array(F.concat(F.lower("p_type"), F.lit("|"), F.replace("p_name", F.lit(" "), F.lit("|"))), F.col("p_brand")).alias("keywords"),
    )
    return catalog.keyword_tree(parts)


@query(W + f""", rows AS (SELECT id, trim(names[i]) AS name, i, width * height AS area FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM photos WHERE {IN_LIBRARY})),
firsts AS (SELECT id, lower(name) AS person, arg_min(name, i) AS name, min(i) AS i, any_value(area) AS area FROM rows WHERE name <> '' GROUP BY ALL)
SELECT person, arg_min(name, (id, i)) AS name, count(*) AS n, arg_max(id, (area, -id)) AS cover FROM firsts GROUP BY person""")
def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.people_in(visible(photos(spark, sf_dir)))


@query(f"""WITH {FOLDERS_CTE}, counted AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS own FROM folders GROUP BY ALL),
below AS (SELECT array_to_string(p[1:k], '/') AS folder, own FROM (SELECT string_split(folder, '/') AS p, own, unnest(range(1, len(string_split(folder, '/')) + 1)) AS k FROM counted))
SELECT b.folder, coalesce(any_value(c.own), 0) AS own, sum(b.own)::BIGINT AS total FROM below b LEFT JOIN counted c USING (folder) GROUP BY b.folder""")
def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.folder_tree(folders(spark, sf_dir))


@query("SELECT least(255, greatest(0, floor((embedding[1]::DOUBLE + 0.5) * 255 + 0.5)))::INT AS bin, count(*) AS n FROM embeddings GROUP BY bin")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.histogram(read(spark, sf_dir, "embeddings").select((F.col("embedding")[0].cast("double") + 0.5).alias("v")), "v")


@query(W + f"""SELECT id, list_sort(list(DISTINCT l_suppkey)) AS albums, count(DISTINCT l_suppkey) AS n FROM photos JOIN lineitem ON l_partkey = id WHERE {IN_LIBRARY} GROUP BY id""")
def album_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The albums of each photo, from the table of members; a photo's list is as long as it has albums."""
    members = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("album"), F.col("l_partkey").alias("id")).distinct()
    found = members.join(visible(photos(spark, sf_dir)).select("id"), "id", "left_semi")
    return found.groupBy("id").agg(F.sort_array(F.collect_list("album")).alias("albums"), F.count("*").alias("n"))


@query("""SELECT conv_id AS album, count(*) AS n FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id WHERE coalesce(toxic, 0) = 0 GROUP BY conv_id""")
def album_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each album that aren't deleted."""
    gone = read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("conv_id"))
    members = read(spark, sf_dir, "conversations").join(gone, "conv_id", "left_anti")
    return members.groupBy(F.col("conv_id").alias("album")).agg(F.count("*").alias("n"))


# keyword edits

#: Of a list ``l`` of trimmed keywords those that are no earlier one's but for case.
_FIRST = "list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)"


def _edited(edit: str) -> str:
    return f"SELECT id, list_filter(list_transform(keywords, lambda k: trim({edit})), lambda k: k <> '') AS l FROM photos WHERE {IN_LIBRARY}"


_RENAMED = _edited("CASE WHEN lower(k) = 'travel' THEN 'Trips' WHEN starts_with(lower(k), 'travel|') THEN 'Trips' || substr(k, 7) ELSE k END")


@query(W + f"SELECT id, list_sort({_FIRST}) AS keywords FROM ({_RENAMED})")
def keyword_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = visible(photos(spark, sf_dir))
    return found.select("id", F.sort_array(keywords.rename(F.col("keywords"), "travel", "Trips")).alias("keywords"))


@query(W + f"SELECT id, list_filter(keywords, lambda k: NOT (lower(k) = 'nature|tree' OR starts_with(lower(k), 'nature|tree|'))) AS keywords FROM photos WHERE {IN_LIBRARY}")
def keyword_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible(photos(spark, sf_dir)).select("id", keywords.delete(F.col("keywords"), "Nature|Tree").alias("keywords"))


_MERGED = _edited("""CASE WHEN lower(k) = 'nature|bird' OR starts_with(lower(k), 'nature|bird|') THEN 'Animals' || substr(k, 12)
WHEN lower(k) = 'nature' OR starts_with(lower(k), 'nature|') THEN 'Outside' || substr(k, 7) ELSE k END""")


@query(W + f"SELECT id, {_FIRST} AS keywords FROM ({_MERGED})")
def keyword_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = visible(photos(spark, sf_dir))
    return found.select("id", keywords.merge(F.col("keywords"), {"nature": "Outside", "nature|bird": "Animals"}).alias("keywords"))


@query(W + f"""SELECT k AS keyword FROM (SELECT DISTINCT p_brand AS k FROM part UNION SELECT 'Nature|Sea' UNION SELECT 'nature|bird') WHERE NOT EXISTS (
SELECT 1 FROM (SELECT DISTINCT lower(unnest(keywords)) AS u FROM photos) WHERE u = lower(k) OR starts_with(u, lower(k) || '|'))""")
def keyword_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed keywords that no photo has, nor one below them."""
    listed = read(spark, sf_dir, "part").select(F.col("p_brand").alias("keyword")).union(spark.range(1).select(F.explode(F.array(F.lit("Nature|Sea"), F.lit("nature|bird")))))
    return keywords.unused(listed.distinct(), photos(spark, sf_dir))


@query(W + f"""SELECT id, list_sort(list_distinct(list_filter(flatten(list_transform(keywords, lambda k: string_split(lower(k), '|'))), lambda x: trim(x) <> ''))) AS exported FROM photos WHERE {IN_LIBRARY}""")
def keyword_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own name and ancestors of each keyword, without regard to case."""
    return visible(photos(spark, sf_dir)).select("id", F.sort_array(keywords.export(F.col("keywords"))).alias("exported"))


@query(W + f"""SELECT keyword, count(DISTINCT id) AS n FROM (SELECT id, unnest(keywords) AS keyword FROM photos WHERE {IN_LIBRARY}) WHERE keyword <> 'Nature|Sea'
AND id IN (SELECT id FROM photos WHERE list_contains(keywords, 'Nature|Sea')) GROUP BY keyword ORDER BY n DESC, lower(keyword), keyword LIMIT 5""")
def keyword_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photolith.operators.joins import cooccurring

    rows = visible(photos(spark, sf_dir)).select("id", F.explode("keywords").alias("keyword"))
    return cooccurring(rows, "Nature|Sea", 5)


# sequences

_SECS = "floor(epoch(ts))::BIGINT"


def _user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("secs"), "event_type", "value",
        F.concat(F.col("event_type"), F.lit("_"), F.col("event_id").cast("string")).alias("file_name"), F.col("value").alias("sharpness"),
    )


_RUNS = f"""e AS (SELECT event_id AS id, user_id, {_SECS} AS secs, event_type, value, event_type || '_' || event_id AS file_name FROM events),
f AS (SELECT *, CASE WHEN secs - lag(secs) OVER w <= GAP THEN 0 ELSE 1 END AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY secs, lower(file_name), id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY secs, lower(file_name), id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM f)"""


@query("WITH " + _RUNS.replace("GAP", "7200") + " SELECT user_id, run, count(*) AS n, list(id ORDER BY secs, lower(file_name), id) AS members FROM g GROUP BY user_id, run HAVING count(*) >= 2")
def auto_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.auto_stacks(_user_events(spark, sf_dir), ["user_id"], 7200)


@query(f"""WITH e AS (SELECT event_id AS id, user_id, {_SECS} AS secs, event_type, value FROM events),
f AS (SELECT *, CASE WHEN secs - lag(secs) OVER w <= 43200 AND event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY secs, id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY secs, id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM f)
SELECT user_id, run, count(*) AS n, arg_max(id, (value, -secs, -id)) AS best, min(id) AS first FROM g GROUP BY user_id, run""")
def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("secs", "id")
    rows = _user_events(spark, sf_dir).withColumn("alike", F.col("event_type") == F.lag("event_type").over(w))
    return sequences.bursts(rows, ["user_id"], 43200, F.col("alike"))


@query(W + f"""SELECT id, CASE WHEN top IS NULL THEN 'review' WHEN sharpness = top AND ties > 1 THEN 'review' WHEN sharpness = top THEN 'keep' ELSE 'drop' END AS decision FROM (
SELECT *, count(*) FILTER (sharpness = top) OVER (PARTITION BY burst) AS ties FROM (SELECT *, max(sharpness) OVER (PARTITION BY burst) AS top FROM photos WHERE burst IS NOT NULL AND {IN_LIBRARY}))""")
def cull_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = visible(photos(spark, sf_dir)).where("burst is not null")
    return sequences.cull_plan(rows, ["burst"]).select("id", "decision")


@query(f"""WITH e AS (SELECT event_id AS id, user_id, {_SECS} AS secs, event_type FROM events), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY secs, id) AS place,
row_number() OVER (PARTITION BY user_id ORDER BY secs, id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY secs, id) AS i FROM e)
SELECT user_id, event_type, min(place) AS first, count(*) AS n FROM p GROUP BY user_id, event_type, i""")
def header_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences.header_runs(_user_events(spark, sf_dir), "event_type", [F.col("secs"), F.col("id")], ["user_id"])
    return found.select("user_id", "event_type", F.col("first").cast("long").alias("first"), "n")


@query("""SELECT conv_id AS stack_id, turn AS stack_pos, min(turn) OVER (PARTITION BY conv_id) AS anchor FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""")
def arrange_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stack_id"), F.col("turn").alias("stack_pos"))
    return sequences.arrange_stacks(rows, ["stack_pos"], True).select("stack_id", "stack_pos", F.col("anchor.stack_pos").alias("anchor"))


@query(W + f""", listed AS (SELECT id, CASE WHEN id % 5 < 3 THEN id - id % 5 END AS stack_id, (id * 7) % 5 AS stack_pos, id % 2 = 0 AS open FROM photos WHERE {IN_LIBRARY} AND rating >= 1),
s AS (SELECT *, min(coalesce(captured, '') || '/' || lpad(id::VARCHAR, 12, '0')) OVER (PARTITION BY coalesce(stack_id, -id - 1)) AS anchor, row_number() OVER (PARTITION BY coalesce(stack_id, -id - 1) ORDER BY stack_pos, id) AS k
FROM listed JOIN (SELECT id, captured FROM photos) USING (id))
SELECT id, stack_id, row_number() OVER (ORDER BY anchor, k) AS place FROM s WHERE k = 1 OR stack_id IS NULL OR stack_id % 10 <> 0""")
def arrange_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's order with stacks: every second one collapsed to its top, the members of the others together, in their
    order, where the first of them stands."""
    rows = visible(photos(spark, sf_dir)).where("rating >= 1").select(
        "id", F.when(F.col("id") % 5 < 3, F.col("id") - F.col("id") % 5).alias("stack_id"), (F.col("id") * 7 % 5).alias("stack_pos"), F.coalesce("captured", F.lit("")).alias("captured")
    )
    shown = sequences.stacks_in_order(rows.withColumn("collapsed", F.col("stack_id") % 10 == 0), ["captured", "id"])
    return numbered(shown, [], ["anchor", "stack_place"]).select("id", "stack_id", "place")


@query("""WITH n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)
SELECT user_id, event_id FROM n WHERE c <= 20 OR k = 0 OR floor(k * 19 / (c - 1)) <> floor((k - 1) * 19 / (c - 1))""")
def thin_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return sequences.thin(rows, ["user_id"], ["ts", "event_id"], 20).select("user_id", "event_id")


@query("""SELECT user_id, list(event_type ORDER BY ts, event_id)[-10:] AS tail FROM events GROUP BY user_id""")
def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten steps of each user; no user's history is gathered whole."""
    kept = sequences.last_steps(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 10)
    steps = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    return kept.groupBy("user_id").agg(steps.alias("tail"))


@query(W + f"SELECT strftime(captured::TIMESTAMP, '%B %Y') AS header, count(*) AS n FROM photos WHERE {IN_LIBRARY} AND captured IS NOT NULL GROUP BY header UNION ALL SELECT 'Unknown Date', count(*) FROM photos WHERE {IN_LIBRARY} AND captured IS NULL")
def date_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible(photos(spark, sf_dir)).groupBy(times.group_label(F.col("captured"), "month").alias("header")).agg(F.count("*").alias("n"))


@query(W + """SELECT id, row_number() OVER (PARTITION BY label ORDER BY captured NULLS FIRST, id) + 99 AS seq FROM photos WHERE label IS NOT NULL""")
def rename_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from 100 on, in the order of capture within each label."""
    rows = photos(spark, sf_dir).where("label is not null").select("id", "label", "captured")
    return numbered(rows, ["label"], ["captured", "id"]).select("id", (F.col("place") + 99).alias("seq"))
