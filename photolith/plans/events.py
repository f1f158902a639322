"""Queries of the change log and of the streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith.operators import changes
from photolith.plans.registry import query
from photolith.sources.photos import PHOTOS_CTE, photos, read, stream
from photolith.streaming import logs

W = f"WITH {PHOTOS_CTE} "
_OPS = "ops AS (SELECT event_id AS seq, user_id AS entity, event_type AS field, round(value, 4) AS value FROM events)"


def _ops(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("entity"), F.col("event_type").alias("field"), F.round("value", 4).alias("value"))


def _middle(ops: DataFrame) -> int:
    """Half of the last operation's number."""
    return (ops.agg(F.max("seq")).first()[0] or 0) // 2


@query(f"WITH {_OPS} SELECT entity, field, arg_max(value, seq) AS value, max(seq) AS seq FROM ops GROUP BY ALL")
def fold_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.fold(_ops(read(spark, sf_dir, "events")))


@query(f"WITH {_OPS} SELECT entity, field, arg_max(value, seq) AS value, max(seq) AS seq FROM ops WHERE seq <= (SELECT max(seq) // 2 FROM ops) GROUP BY ALL")
def undo_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state as of an earlier operation."""
    ops = _ops(read(spark, sf_dir, "events"))
    return changes.fold(ops, _middle(ops))


@query(f"WITH {_OPS} SELECT seq, entity, field, value, lag(value) OVER (PARTITION BY entity, field ORDER BY seq) AS before FROM ops")
def inverse_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.undo(_ops(read(spark, sf_dir, "events")))


@query(f"WITH {_OPS} SELECT entity, field, arg_max(value, seq) AS value, max(seq) AS seq FROM ops GROUP BY ALL")
def compact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of the first part, and the rest of the log with some records repeated, give the whole state."""
    ops = _ops(read(spark, sf_dir, "events"))
    middle = _middle(ops)
    return changes.compact(changes.fold(ops, middle), changes.after_snapshot(ops.unionByName(ops.where("seq % 3 = 0")), middle))


@query("SELECT event_id AS seq, event_type || ':' || user_id AS op FROM events WHERE event_id % 11 <> 3 AND event_id % 13 <> 5")
def decode_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a log, some with a wrong checksum and some torn off."""
    op = F.concat("event_type", F.lit(":"), F.col("user_id").cast("string"))
    crc = F.crc32(op.cast("binary")) + F.when(F.col("event_id") % 11 == 3, 1).otherwise(0)
    line = F.concat(F.lit('{"seq":'), F.col("event_id").cast("string"), F.lit(',"crc":'), crc.cast("string"), F.lit(',"op":'), op, F.lit("}"))
    torn = F.when(F.col("event_id") % 13 == 5, F.left(line, F.length(line) - 1)).otherwise(line)
    return changes.decode(read(spark, sf_dir, "events").select(torn.alias("value"))).select("seq", "op")


@query(W + """SELECT id, CASE WHEN id IN (SELECT conv_id FROM conversations) THEN 'kept_used' WHEN 1717200000 - captured_secs <= 900 * 86400 THEN 'kept_recent' WHEN is_edited THEN 'kept_edited' ELSE 'forget' END AS fate
FROM photos WHERE local AND captured_secs IS NOT NULL""")
def forget_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir).where("local and captured_secs is not null").withColumn("secs", F.col("captured_secs"))
    used = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"))
    return changes.forget_plan(rows, used, 1717200000, 900).select("id", "fate")


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base or 'file://' + tempfile.mkdtemp(prefix='photolith-')}/stream-{uuid.uuid4().hex}"


@query(f"WITH {_OPS} SELECT entity, field, arg_max(value, seq) AS value, max(seq) AS seq FROM ops GROUP BY ALL")
def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream: each batch is merged into a versioned snapshot."""
    return spark.read.parquet(logs.run_fold(_ops(stream(spark, sf_dir, "events")), spark, shared_folder(spark)))


@query(W + """SELECT f.id, f.path, CASE WHEN p.path IS NULL THEN 'new' WHEN p.deleted THEN 'deleted' ELSE 'known' END AS outcome
FROM (SELECT id, CASE WHEN id % 3 = 0 THEN path || '-2' ELSE path END AS path FROM photos) f LEFT JOIN (SELECT path, bool_and(deleted) AS deleted FROM photos GROUP BY path) p USING (path)""")
def stream_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the watched folder as a stream, each reported twice, a third of them under new names."""
    library = photos(spark, sf_dir).select("id", "path", "deleted")
    path = F.concat(F.lit("/photos/"), "source", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("/"), "lang")), F.lit("/img_"), F.col("doc_id").cast("string"))
    files = stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.concat(path, F.lit("-2"))).otherwise(path).alias("path"), F.explode(F.array(F.lit(1), F.lit(2))).alias("report"))
    return logs.run_arrivals(files, library, shared_folder(spark))


@query("""SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY ALL""")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed counts of a stream, all windows out at its end."""
    counts = stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    out = f"{shared_folder(spark)}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n")
