"""The change log and the watch folder as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photolith.operators.changes import compact
from photolith.operators.joins import arrivals


def run_fold(stream: DataFrame, spark: SparkSession, state_dir: str) -> str:
    """Merges each batch of a stream of operations into a versioned snapshot; returns the last version's path.

    A batch writes a new version and never the one it reads, and a repeated batch writes the same version again."""
    last = {"path": None}

    def merge(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{state_dir}/v{number - 1}") if number else batch.limit(0).select("entity", "field", "value", "seq")
        compact(before, batch).write.mode("overwrite").parquet(f"{state_dir}/v{number}")
        last["path"] = f"{state_dir}/v{number}"
        if number > 1:  # a repeated batch reads the version before it, and none earlier
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{state_dir}/v{number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return last["path"]


_TAKEN = "path string, scan long, size long"


def stable_files(before: DataFrame, scans: DataFrame) -> DataFrame:
    """(path, size, done) so far and new scans (path, scan, size) -> (path, size, done, taken): the state after them, and with
    a file whose size was the same and above 0 in two scans in a row the second one (scan, size), once."""
    rows = before.select("path", F.lit(None).cast("long").alias("scan"), "size", "done").unionByName(scans.select("path", "scan", "size", F.lit(False).alias("done")))
    same = F.lag("size").over(Window.partitionBy("path").orderBy(F.asc_nulls_first("scan"))) == F.col("size")
    found = rows.withColumn("stable", F.coalesce(same & (F.col("size") > 0) & F.col("scan").isNotNull(), F.lit(False)))
    at, first = F.struct("scan", "size"), F.min(F.when(F.col("stable"), F.struct("scan", "size")))
    # nulls are the least of structs' fields, so the state before comes first here too
    return found.groupBy("path").agg(
        F.max_by("size", at).alias("size"), (F.bool_or("done") | F.bool_or("stable")).alias("done"), F.when(~F.bool_or("done"), first).alias("taken")
    )


def run_stable(scans: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """A stream of scans (path, scan, size) -> (path, scan, size) of the files that ``stable_files`` takes.

    As in ``run_fold`` each batch is merged into a versioned snapshot, of which it writes a new one; a repeated batch writes
    the same version and the same files again."""
    taken = f"{folder}/taken"
    spark.createDataFrame([], _TAKEN).write.mode("overwrite").parquet(f"{taken}/batch=-1")

    def merge(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{folder}/v{number - 1}") if number else batch.sparkSession.createDataFrame([], "path string, size long, done boolean")
        stable_files(before.select("path", "size", "done"), batch).write.mode("overwrite").parquet(f"{folder}/v{number}")
        spark.read.parquet(f"{folder}/v{number}").where("taken is not null").select("path", "taken.*").write.mode("overwrite").parquet(f"{taken}/batch={number}")
        if number > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    query = scans.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(_TAKEN).parquet(f"{taken}/batch=*")


def run_arrivals(files: DataFrame, library: DataFrame, folder: str) -> DataFrame:
    """A stream of (id, path) of files in the watched folder -> (id, path, outcome), as ``joins.arrivals`` tells it in a batch.

    A path counts when it arrives first: that is state, keyed by path, so a file that comes again in a later batch or run is
    passed by. What was deleted from the library is looked up when a file arrives and doesn't come back by itself."""
    spark = library.sparkSession
    first = files.select("id", "path").dropDuplicates(["path"])
    told = arrivals(first, library)
    query = told.writeStream.format("parquet").option("path", f"{folder}/arrived").option("checkpointLocation", f"{folder}/checkpoint")
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{folder}/arrived")


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per kind and day, closed when the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
