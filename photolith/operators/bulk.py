"""Set operations and bulk edits: selections, stacks, repair, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photolith.operators.numbering import numbered
from photolith.session import checkpointed

#: Fixed value: colours of labels.
COLOURS = ("red", "yellow", "green", "blue", "purple")


def toggle(selected: DataFrame, clicked: DataFrame) -> DataFrame:
    """What is in one of two id sets but not in both."""
    both = selected.select("id").distinct().withColumn("_a", F.lit(1)).join(clicked.select("id").distinct().withColumn("_b", F.lit(1)), "id", "full")
    return both.where("_a is null or _b is null").select("id")


def select_range(listed: DataFrame, order: list[str], partition: list[str], first: int, last: int) -> DataFrame:
    """Rows between two places of each list by the columns ``order``, both included; lists can be of any length."""
    return numbered(listed, partition, order).where(F.col("place").between(min(first, last), max(first, last)))


def select_by(shown: DataFrame, flag: str | None = None, rating: int | None = None, rating_op: str = "gte", label: str | None = None, add_to: DataFrame | None = None) -> DataFrame:
    """(id): the shown photos that meet every given test, and those of ``add_to`` (id) if there is one.

    ``rating_op`` is gte, lte or eq; ratings above 5 count as 5; the label "none" is no label. One test at least is needed."""
    if flag is None and rating is None and label is None:
        raise ValueError("a flag, a rating or a label is needed")
    if flag not in (None, "pick", "reject", "none") or label not in (None, "none", *COLOURS):
        raise ValueError("an unknown flag or label")
    test = F.lit(True)
    if flag is not None:
        test = test & (F.col("flag") == flag)
    if rating is not None:
        want = min(rating, 5)
        test = test & {"eq": F.col("rating") == want, "lte": F.col("rating") <= want}.get(rating_op, F.col("rating") >= want)
    if label is not None:
        test = test & (F.col("label").isNull() if label == "none" else F.col("label") == label)
    found = shown.where(test).select("id")
    return found if add_to is None else add_to.select("id").unionAll(found).distinct()


def without(members: Column, gone: Column) -> Column:
    """An ordered list without some members; repeated ones that stay are kept."""
    return F.filter(members, lambda m: ~F.array_contains(gone, m))


def merge_stacks(first: Column, second: Column) -> Column:
    """Two stacks as one, the first's top on top, each member once."""
    return F.array_distinct(F.concat(first, second))


def split_stack(members: Column, at: int) -> tuple[Column, Column]:
    """Members before and from a place (counted from 1); parts of a single member are no stack and come back null."""
    head, tail = F.slice(members, 1, at - 1), F.slice(members, at, F.greatest(F.size(members) - at + 1, F.lit(0)))
    return F.when(F.size(head) >= 2, head), F.when(F.size(tail) >= 2, tail)


def drop_members(stacks: DataFrame, gone: DataFrame) -> DataFrame:
    """(stack_id, pos, id) without photos that are gone; stacks that are left with one member end."""
    left = stacks.join(gone.select("id"), "id", "left_anti")
    n = F.count("*").over(Window.partitionBy("stack_id"))
    place = F.row_number().over(Window.partitionBy("stack_id").orderBy("pos"))
    return left.withColumn("_n", n).where("_n >= 2").withColumn("pos", place).drop("_n")


def find_missing(missing: DataFrame, found: DataFrame) -> DataFrame:
    """(id, name, size, hash) lost and (id, name, size, hash) on disk -> (id, found_id, how).

    First by name, size and content, then by size and content, then by name and size if there is one such file; a found
    file is used once, by the lowest id. Both sides are one table that goes through the three steps; what is matched passes
    the later ones by, so neither side is read again."""
    one = lambda rows, side: rows.select(F.lit(side).alias("side"), F.col("id"), F.lower("name").alias("name"), "size", "hash")
    rows = one(missing, 0).unionAll(one(found, 1))
    rows = rows.select(F.when(F.col("side") == 0, F.col("id")).alias("id"), F.when(F.col("side") == 1, F.col("id")).alias("found_id"), "name", "size", "hash", F.lit(None).cast("string").alias("how"))
    for how, keys in (("same", ["name", "size", "hash"]), ("renamed", ["size", "hash"]), ("name", ["name", "size"])):
        rows = _match_step(rows, how, keys)
    return rows.where("how is not null").select("id", "found_id", "how")


def _match_step(rows: DataFrame, how: str, keys: list[str]) -> DataFrame:
    """Of equal keys the k-th lost file is the k-th found one; for ``name`` only a single found one counts. Files with a key
    that is null, and matched ones, have a key of their own."""
    free = F.col("how").isNull()
    for k in keys:
        free = free & F.col(k).isNotNull()
    at = {f"_{k}": F.when(free, F.col(k)) for k in keys}
    rows = rows.withColumns(at | {"_own": F.when(~free, F.struct("id", "found_id")), "_side": F.col("id").isNull()})
    same = Window.partitionBy(*at, "_own", "_side")
    rows = rows.withColumn("_k", F.row_number().over(same.orderBy("id", "found_id")))
    if how == "name":
        rows = rows.withColumn("_k", F.when(F.col("_side") & (F.count("*").over(same) > 1), -F.col("_k")).otherwise(F.col("_k")))
    kept = ["name", "size", "hash"]
    paired = rows.groupBy(*at, "_own", "_k").agg(
        F.max("id").alias("id"), F.max("found_id").alias("found_id"), F.max("how").alias("how"), *[F.max_by(c, F.when(F.col("_side"), 0).otherwise(1)).alias(c) for c in kept]
    )
    both = F.col("id").isNotNull() & F.col("found_id").isNotNull() & F.col("how").isNull()
    return paired.select("id", "found_id", *kept, F.when(both, how).otherwise(F.col("how")).alias("how"))


def rates(rows: DataFrame, keys: list[str], predicted: Column, actual: Column) -> DataFrame:
    """Precision, recall and false-reject rate of a yes-or-no prediction."""
    tp, fp = F.count_if(predicted & actual), F.count_if(predicted & ~actual)
    fn, tn = F.count_if(~predicted & actual), F.count_if(~predicted & ~actual)
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(fn, fn + tp).alias("false_reject"), ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"))


def repair_albums(albums: DataFrame) -> DataFrame:
    """(id, parent): parents that don't exist, or that lead back to the album, become null.

    A chain is followed upwards by doubling: after k joins it has been followed 2^k steps. It ends when no album has an
    ancestor so far up, or after as many steps as there are albums, which only loops outlast."""
    known = albums.select(F.col("id").alias("parent")).distinct()
    clean = checkpointed(albums.join(known.withColumn("_known", F.lit(True)), "parent", "left").select("id", F.when(F.col("_known"), F.col("parent")).alias("parent")))
    jump = clean.select("id", F.col("parent").alias("up"))
    for _ in range(clean.count().bit_length()):
        after = jump.select(F.col("id").alias("up"), F.col("up").alias("next"))
        jump = checkpointed(jump.join(after, "up", "left").select("id", F.col("next").alias("up")))
        if jump.where("up is not null").isEmpty():
            break
    # what still has an ancestor after that many steps is on or below a loop
    looping = jump.where("up is not null").select("id").withColumn("_loop", F.lit(True))
    return clean.join(looping, "id", "left").select("id", F.when(F.col("_loop").isNull(), F.col("parent")).alias("parent"))
