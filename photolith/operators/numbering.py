"""Places in long lists: one list can hold most rows, so it is numbered in ranges, not in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: So many keys per range are looked at when the ranges' bounds are chosen.
SAMPLED = 32


def _bounds(rows: DataFrame, keys: list[str], ranges: int) -> list[tuple]:
    """Keys that cut all rows into about even ranges. They are chosen by hash, each once, so their number is bounded."""
    n = rows.count()
    of = F.struct(*keys)
    chosen = rows.select(of.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLED * ranges / max(1, n)))).distinct()
    found = [tuple(r["k"]) for r in chosen.orderBy("k").collect()]
    return [found[len(found) * k // ranges] for k in range(1, ranges)] if len(found) >= ranges else []


def _literal(value: object, kind: DataType) -> Column:
    if isinstance(kind, StructType) and value is not None:
        return F.struct(*[_literal(v, field.dataType).alias(field.name) for v, field in zip(value, kind.fields, strict=True)])
    return F.lit(value).cast(kind)


def range_of(rows: DataFrame, keys: list[str], ranges: int) -> Column:
    """Which of about even ranges of the keys a row is in, 0 first; nulls come first."""
    kinds = [rows.schema[k].dataType for k in keys]
    bounds = [F.struct(*[_literal(v, kind).alias(k) for v, kind, k in zip(b, kinds, keys, strict=True)]) for b in _bounds(rows, keys, ranges)]
    if not bounds:
        return F.lit(0)
    own = F.struct(*keys)
    return F.size(F.filter(F.array(*bounds), lambda b: b <= own))


def numbered(rows: DataFrame, lists: list[str], order: list[str], place: str = "place") -> DataFrame:
    """``rows`` with their place (from 1) in each list by the columns ``order``, ascending, nulls first; these end ties.

    A row's place is its place within its range and the sizes of its list's ranges before, which are a row per list and range."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.withColumn("_range", range_of(rows, [*lists, *order], ranges))
    sizes = found.groupBy(*lists, "_range").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*lists).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(*lists, "_range").orderBy(*[F.asc_nulls_first(c) for c in order]))
    found, sizes = found.withColumn("_within", within).alias("r"), sizes.alias("s")
    same = F.col("r._range") == F.col("s._range")
    for c in lists:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    return found.join(sizes, same).select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("_before") + F.col("_within")).alias(place))
