"""Keywords and people: hierarchical names compared without regard to case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(keyword: Column) -> Column:
    """A path without blank levels and blanks around levels."""
    return F.array_join(F.filter(F.transform(F.split(keyword, r"\|"), lambda x: F.trim(x)), lambda x: x != ""), "|")


def is_under(keyword: Column, path: str) -> Column:
    low, root = F.lower(keyword), path.lower()
    return (low == root) | low.startswith(root + "|")


def reparent(keyword: Column, levels: int, parent: str) -> Column:
    """The first ``levels`` levels replaced by ``parent``."""
    parts = F.split(keyword, r"\|")
    rest = F.slice(parts, levels + 1, F.greatest(F.size(parts) - levels, F.lit(0)))
    return F.array_join(F.concat(F.array(F.lit(parent)), rest), "|")


def distinct_names(names: Column) -> Column:
    """Trimmed, without blanks; of names that differ in case only, the first."""
    trimmed = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")
    return F.aggregate(
        trimmed,
        F.array().cast("array<string>"),
        lambda got, x: F.when(F.exists(got, lambda y: F.lower(y) == F.lower(x)), got).otherwise(F.concat(got, F.array(x))),
    )


def people(names: Column) -> Column:
    return distinct_names(names)


def keyword_count(keywords: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.transform(keywords, lambda k: F.lower(F.trim(k))), lambda x: x != "")))


def from_file(paths: Column, flat: Column) -> Column:
    """Hierarchical paths and those flat names that are no level of one."""
    return F.concat(
        paths, F.filter(flat, lambda f: ~F.exists(paths, lambda p: F.array_contains(F.split(F.lower(p), r"\|"), F.lower(f))))
    )
