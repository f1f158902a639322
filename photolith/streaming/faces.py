"""The index of faces as a stream: only faces that aren't known yet go on to be scored, those of changed photos leave."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from photolith.operators.faces import BOX, rect_key

_CHANGE = "photo long, version long, key string, added boolean, embedding array<float>"


def face_changes(scans: DataFrame) -> DataFrame:
    """(photo, version, x0, y0, x1, y1, embedding) -> (photo, version, key, added, embedding), a stream of both.

    A photo's state is its version and the keys of its faces. Faces of an older version are passed by, as are those whose
    key is known; with a newer version the keys of the one before leave, also where a scan found no face (a null box)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, known = state.get if state.exists else (None, [])
        known, out = set(known), []
        rows = pd.concat(list(frames)).sort_values(["version", "key"], kind="stable")
        for row in rows.itertuples():
            if version is not None and row.version < version:
                continue
            if version is None or row.version > version:
                out += [(key[0], int(row.version), k, False, None) for k in sorted(known)]
                version, known = int(row.version), set()
            if row.key is not None and row.key not in known:
                known.add(row.key)
                out.append((key[0], version, row.key, True, row.embedding))
        state.update((version, sorted(known)))
        if out:
            yield pd.DataFrame(out, columns=["photo", "version", "key", "added", "embedding"])

    keyed = scans.select("photo", F.col("version").cast("long").alias("version"), F.when(F.col("x0").isNotNull(), rect_key()).alias("key"), "embedding")
    return keyed.groupBy("photo").applyInPandasWithState(step, _CHANGE, "version long, keys array<string>", "append", GroupStateTimeout.NoTimeout)


def index_of(changes: DataFrame) -> DataFrame:
    """The faces that are in the index after all changes: those added with their photo's last version."""
    last = changes.groupBy("photo").agg(F.max("version").alias("version"))
    return changes.where("added").join(last, ["photo", "version"]).select("photo", "version", "key", *[c for c in changes.columns if c not in ("photo", "version", "key", "added")])


def run_index(scans: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Takes in what is new in a stream of scans and returns the index. A run goes on where the one before ended: changes are
    appended by the file sink, each batch once, and only added faces are scored (here: the length of their vector)."""
    score = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scored = face_changes(scans).withColumn("score", F.when(F.col("added"), score))
    query = scored.writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint")
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return index_of(spark.read.schema(scored.schema).parquet(f"{folder}/changes"))


def scans_now(scans: DataFrame) -> DataFrame:
    """What the index holds after all scans, in a batch: the distinct faces of each photo's last version."""
    last = scans.groupBy("photo").agg(F.max("version").alias("version"))
    keyed = scans.where(F.col("x0").isNotNull()).join(last, ["photo", "version"]).select("photo", "version", rect_key().alias("key"))
    return keyed.distinct()


__all__ = ["BOX", "face_changes", "index_of", "run_index", "scans_now"]
