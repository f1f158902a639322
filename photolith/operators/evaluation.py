"""How well predicted choices agree with labelled ones: decisions per photo and winners per burst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a, b), 6)


def cull_report(frames: DataFrame, predicted: DataFrame) -> DataFrame:
    """(id, split, burst, label: keep, reject or null, acceptable) and (id, decision: keep, reject or null, winner) -> a row
    per split.

    A photo without a prediction is one on which none was made (abstention), which misses its label. An acceptable photo
    is one to keep, whatever its label. A burst counts if it has acceptable photos, any of which is a right winner; it is
    covered if one of its photos was made winner. Rates without cases are null. Photos of no burst are in none."""
    told = frames.join(predicted.select("id", "decision", "winner"), "id", "left").select(
        "split", "burst", F.col("acceptable").alias("fine"), F.coalesce("winner", F.lit(False)).alias("won"), F.coalesce("decision", F.lit("abstain")).alias("said"),
        F.when(F.col("label") == "reject", "reject").when(F.col("acceptable") | (F.col("label") == "keep"), "keep").alias("truth"),
    )
    n = lambda truth, said: F.count_if((F.col("truth") == truth) & (F.col("said") == said))
    photos = told.groupBy("split").agg(
        F.count("*").alias("photos"), F.count("truth").alias("labelled"), F.count_if((F.col("said") != "abstain") & F.col("truth").isNotNull()).alias("decided"),
        F.count_if(F.col("truth").isNull() & (F.col("said") == "reject")).alias("unknown_rejects"),
        *[n(truth, said).alias(f"{truth}_{said}") for truth in ("keep", "reject") for said in ("keep", "reject", "abstain")],
    )
    bursts = told.where(F.col("burst").isNotNull()).groupBy("split", "burst").agg(
        F.bool_or("fine").alias("counts"), F.bool_or(F.col("fine") & F.col("won")).alias("right"), F.bool_or("won").alias("covered")
    )
    bursts = bursts.where("counts").groupBy("split").agg(F.count("*").alias("bursts"), F.count_if("right").alias("right"), F.count_if("covered").alias("covered"))
    c = F.col
    return photos.join(bursts, "split", "left").select(
        "split", "photos", "labelled", c("keep_reject").alias("false_rejects"), "unknown_rejects", F.coalesce("bursts", F.lit(0)).cast("long").alias("bursts"),
        _ratio(c("keep_keep"), c("keep_keep") + c("reject_keep")).alias("precision"), _ratio(c("keep_keep"), c("keep_keep") + c("keep_reject") + c("keep_abstain")).alias("recall"),
        _ratio(c("reject_reject"), c("reject_reject") + c("keep_reject")).alias("reject_precision"),
        _ratio(c("reject_reject"), c("reject_reject") + c("reject_keep") + c("reject_abstain")).alias("reject_recall"),
        _ratio(c("keep_reject"), c("keep_keep") + c("keep_reject") + c("keep_abstain")).alias("false_reject_rate"), _ratio(c("decided"), c("labelled")).alias("decision_coverage"),
        _ratio(c("right"), c("bursts")).alias("winner_agreement"), _ratio(c("covered"), c("bursts")).alias("winner_coverage"),
    )
