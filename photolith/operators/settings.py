"""Partial settings: patches of nested JSON objects, merged in the order of their numbers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _walk(value: object, path: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], str | None]]:
    """Every object in a patch, as (path, None), and everything else in it, as (path, JSON)."""
    if isinstance(value, dict):
        yield path, None
        for key, inner in value.items():
            yield from _walk(inner, (*path, key))
    else:
        yield path, json.dumps(value, ensure_ascii=False, sort_keys=True)


def paths_of(patches: DataFrame) -> DataFrame:
    """(key, seq, patch) -> (key, seq, path, value): a row for each object of a patch (value null) and for each other value,
    JSON nulls among these. A null patch, or one that isn't JSON, changes nothing."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths, values = [], [], []
            for k, patch in enumerate(batch.column(2).to_pylist()):
                try:
                    told = list(_walk(json.loads(patch), ())) if patch is not None else []
                except ValueError:
                    continue
                at += [k] * len(told)
                paths += [list(p) for p, _ in told]
                values += [v for _, v in told]
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(paths, pa.list_(pa.string())), pa.array(values, pa.string())], ["key", "seq", "path", "value"])

    kind = patches.schema["key"].dataType.simpleString()
    return patches.select("key", F.col("seq").cast("long").alias("seq"), "patch").mapInArrow(rows, f"key {kind}, seq long, path array<string>, value string")


def merged_paths(patches: DataFrame) -> DataFrame:
    """(key, seq, patch) -> (key, path, value): what is left when the patches of a key are merged by ascending ``seq``.

    Objects merge and everything else replaces what was there, an object a plain value too. That isn't associative, so it
    isn't folded: a value is left if nothing later replaces it or an object around it, and no later patch has an object in
    its place. The last value and the last object of each path decide, which tasks find before the shuffle, so a key with
    any number of patches is spread over its paths."""
    last = paths_of(patches).groupBy("key", "path").agg(
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("seq"))).alias("value"),
        F.max(F.when(F.col("value").isNotNull(), F.col("seq"))).alias("set_at"), F.max(F.when(F.col("value").isNull(), F.col("seq"))).alias("object_at"),
    )
    # each path asks those around it, itself among them, for the last plain value there
    asked = last.select("key", "path", "value", "set_at", "object_at", F.explode(F.sequence(F.lit(0), F.size("path"))).alias("depth"))
    asked = asked.withColumn("around", F.slice("path", F.lit(1), F.col("depth"))).drop("depth")
    plain = last.where("set_at is not null").select("key", F.col("path").alias("around"), F.col("set_at").alias("replaced_at"))
    told = asked.join(plain, ["key", "around"], "left").groupBy("key", "path").agg(
        F.first("value").alias("value"), F.first("set_at").alias("set_at"), F.first("object_at").alias("object_at"), F.max("replaced_at").alias("replaced_at")
    )
    # the plain value is the last thing at its place, or an object is and nothing replaced it since
    is_value = F.col("set_at").isNotNull() & (F.col("set_at") >= F.col("replaced_at")) & (F.col("object_at").isNull() | (F.col("object_at") < F.col("set_at")))
    is_object = F.col("object_at").isNotNull() & (F.col("replaced_at").isNull() | (F.col("object_at") > F.col("replaced_at")))
    return told.where(is_value | is_object).select("key", "path", F.when(is_value, F.col("value")).alias("value"))


def deep_merge(patches: DataFrame) -> DataFrame:
    """(key, seq, patch: JSON) -> (key, settings: JSON with sorted keys). Of one key no two patches have the same ``seq``."""

    def assemble(found: list) -> str:
        root: dict = {"": {}}
        for path, value in sorted((tuple(p), v) for p, v in found):
            at = root
            for part in ("", *path[:-1]) if path else ():
                at = at[part]
            at[path[-1] if path else ""] = {} if value is None else json.loads(value)
        return json.dumps(root[""], ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    # one key's settings are one value, which its paths make up
    return merged_paths(patches).groupBy("key").agg(F.collect_list(F.struct("path", "value")).alias("found")).select("key", F.udf(assemble, "string")("found").alias("settings"))
