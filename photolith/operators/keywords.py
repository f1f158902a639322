"""Edits of keyword lists, as expressions on the array, and their upkeep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photolith.functions.names import clean, distinct_names, is_under


def rename(keywords: Column, old: str, new: str) -> Column:
    """``old`` and what is below it moves to ``new``; names that are then the same but for case are one."""
    return distinct_names(F.transform(keywords, lambda k: F.when(is_under(k, old), F.concat(F.lit(new), F.substring(k, len(old) + 1, 1 << 16))).otherwise(k)))


def delete(keywords: Column, path: str) -> Column:
    return F.filter(keywords, lambda k: ~is_under(k, path))


def merge(keywords: Column, into: dict[str, str]) -> Column:
    """Each keyword follows the longest of the named paths that it is under; names that are then the same but for case are one."""
    deepest = sorted(into, key=lambda p: -p.count("|"))

    def move(k: Column) -> Column:
        return reduce(lambda rest, p: F.when(is_under(k, p), F.concat(F.lit(into[p]), F.substring(k, len(p) + 1, 1 << 16))).otherwise(rest), reversed(deepest), k)

    return distinct_names(F.transform(keywords, move))


def add(keywords: Column, path: str) -> Column:
    return F.when(F.exists(keywords, lambda k: F.lower(k) == path.lower()), keywords).otherwise(F.concat(keywords, F.array(F.lit(path))))


def export(keywords: Column) -> Column:
    """All levels of all keywords in lower case, each once."""
    parts = F.flatten(F.transform(keywords, lambda k: F.split(F.lower(k), r"\|")))
    return F.array_distinct(F.filter(parts, lambda p: F.trim(p) != ""))


def unused(listed: DataFrame, photos: DataFrame) -> DataFrame:
    """Listed keywords with no photo at or below them: an anti-join on all prefixes of the keywords in use."""
    from photolith.operators.catalog import levels

    used = photos.select(F.explode("keywords").alias("k")).distinct().select(F.explode(levels(F.lower("k"))).alias("level")).distinct()
    return listed.join(used, F.lower(listed.keyword) == used.level, "left_anti")


def union_lists(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Two keyword lists (path, synonyms) as one: our spelling, both's synonyms."""
    key = lambda df, p: df.select(F.lower(clean(F.col("path"))).alias("key"), F.col("path").alias(f"{p}_path"), F.col("synonyms").alias(f"{p}_syn"))
    both = key(ours, "our").join(key(theirs, "their"), "key", "full")
    empty = F.array().cast("array<string>")
    return both.select(
        F.coalesce("our_path", "their_path").alias("path"),
        distinct_names(F.concat(F.coalesce("our_syn", empty), F.coalesce("their_syn", empty))).alias("synonyms"),
    )
