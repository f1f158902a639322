"""Embedding vectors: cosine similarity, ranks, suggestions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group holds so many rows of a side, about, and so many scores at once.
BLOCK_ROWS = 65_536
HELD_SCORES = 1 << 22


def grid(asked: DataFrame, held: DataFrame, block_rows: int) -> tuple[int, int]:
    """Into how many blocks and parts two sides are dealt. Each row is sent once for every one of the other side, so these are
    the square root of the shuffle's partitions, enough groups for all, as long as groups of ``block_rows`` a side hold all."""
    least = math.ceil(math.sqrt(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return max(least, -(-asked.count() // block_rows)), max(least, -(-held.count() // block_rows))


def dot(a: Column, b: Column) -> Column:
    """Of unit vectors, in double precision; null if their lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product)


def similar(rows: DataFrame, query: list[float], least: float = 0.8) -> DataFrame:
    """Rows at least so similar to one vector, which goes along as a literal: a scan, no join."""
    score = dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    return rows.withColumn("score", score).where(F.col("score") >= least)


def rank_people(unknown: DataFrame, known: DataFrame, best: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per unknown vector and person the mean of its ``best`` similarities. (id, embedding), (person, embedding).

    The unknown vectors are a query set against all known ones, in blocks: each block of queries meets each part of the
    known rows once, as a product of matrices, and only the best of a part go on; no pair is a row."""
    blocks, parts = grid(unknown, known, block_rows)
    asked = unknown.select("id", "embedding", F.pmod(F.hash("id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    # named anew, as both sides may come from one table
    held = known.select(F.col("person").alias("person"), F.col("embedding").alias("embedding"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.hash("embedding"), F.lit(parts)).alias("part"))

    def top(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        for length, held in held.groupby(held["embedding"].map(len)):  # noqa: B020
            alike = asked[asked["embedding"].map(len) == length]  # others have no likeness
            if not len(alike):
                continue
            ids, others = alike["id"].to_numpy(), np.stack(held["embedding"].to_numpy()).astype(float).T
            vectors, people = np.stack(alike["embedding"].to_numpy()).astype(float), held.groupby("person").indices
            step = max(1, HELD_SCORES // len(held))
            for k in range(0, len(ids), step):
                scores = -(vectors[k : k + step] @ others)
                for person, at in people.items():
                    found = scores[:, at]
                    if len(at) > best:
                        found = np.partition(found, best - 1, axis=1)[:, :best]
                    found = -np.sort(found, axis=1)
                    out.append(pd.DataFrame({"id": np.repeat(ids[k : k + step], found.shape[1]), "person": person, "score": found.ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "person": [], "score": []}, dtype=object)

    schema = f"id long, person {known.schema['person'].dataType.simpleString()}, score double"
    partial = asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInPandas(top, schema)
    place = F.row_number().over(Window.partitionBy("id", "person").orderBy(F.desc("score")))
    return partial.withColumn("_k", place).where(F.col("_k") <= best).groupBy("id", "person").agg(F.avg("score").alias("score"), F.count("*").alias("n"))


def top_similar(asked: DataFrame, held: DataFrame, best: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, embedding) twice -> (id, other, score, place): of each asked vector the ``best`` most alike others, ties by id.

    Blocks as in ``rank_people``: a block of queries meets each part of the held rows once, and a part's best go on."""
    blocks, parts = grid(asked, held, block_rows)
    left = asked.select("id", "embedding", F.pmod(F.hash("id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = held.select("id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.hash("id"), F.lit(parts)).alias("part"))

    def best_of_part(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            held = held.sort_values("id", ignore_index=True)  # a stable sort then breaks ties by id
            ids, others = asked["id"].to_numpy(), held["id"].to_numpy()
            vectors, across = np.stack(asked["embedding"].to_numpy()).astype(float), np.stack(held["embedding"].to_numpy()).astype(float).T
            step = max(1, HELD_SCORES // len(held))
            for k in range(0, len(ids), step):
                own = ids[k : k + step]
                scores = vectors[k : k + step] @ across
                scores[own[:, None] == others[None, :]] = -np.inf  # not with itself
                order = np.argsort(-scores, axis=1, kind="stable")[:, :best]
                found = np.take_along_axis(scores, order, 1)
                out.append(pd.DataFrame({"id": np.repeat(own, order.shape[1]), "other": others[order].ravel(), "score": found.ravel()}))
        found = pd.concat(out) if out else pd.DataFrame({"id": [], "other": [], "score": []})
        return found[found["score"] > -np.inf]

    partial = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(best_of_part, "id long, other long, score double")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return partial.withColumn("place", place).where(F.col("place") <= best)


def suggest(ranked: DataFrame, least: float, margin: float) -> DataFrame:
    """The best person, if good enough and far enough before the next."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "person")
    found = ranked.withColumn("_next", F.lead("score").over(w)).withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return found.where((F.col("score") >= least) & (F.col("_next").isNull() | (F.col("score") - F.col("_next") >= margin))).select("id", "person", "score")
