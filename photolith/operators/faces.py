"""Faces: groups of likeness with faces kept apart, regions matched to detections, and the fit that aligns a face."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photolith.operators.joins import overlap
from photolith.operators.numbering import numbered
from photolith.operators.vectors import BLOCK_ROWS, HELD_SCORES, rank_people
from photolith.session import checkpointed, written

PER_PASS = 1000
#: So many numbers (groups times the length of their vectors) are merged in one task.
TOGETHER = 1 << 20
#: Likenesses this close are equal: the order in which a product is summed moves the last digits.
PLACES, TIE = 12, 1e-12
LEAST_OVERLAP = 0.3
BOX = ("x0", "y0", "x1", "y1")


def likeness(vectors: list[np.ndarray]) -> np.ndarray:
    """Cosines of unit vectors; minus infinity for a vector with itself, and where two have no cosine: vectors of different
    lengths, empty ones, and ones with a number that isn't finite."""
    n = len(vectors)
    out = np.full((n, n), -np.inf)
    lengths = np.array([len(v) for v in vectors])
    for length in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == length)
        block = np.stack([vectors[k] for k in at]).astype(float)
        usable = np.isfinite(block).all(1)
        at, block = at[usable], block[usable]
        out[np.ix_(at, at)] = block @ block.T
    np.fill_diagonal(out, -np.inf)
    return out


def merge_groups(mean: np.ndarray, threshold: float) -> np.ndarray:
    """Each row's group (its lowest row): the two groups of the highest mean merge while it is at least ``threshold``, those
    of the lowest rows on ties. Minus infinity stays in every mean it enters, so such rows never share a group."""
    n = len(mean)
    mean, sizes, label = mean.copy(), np.ones(n), np.arange(n)
    best = mean.argmax(1) if n else np.zeros(0, np.int64)
    while n:
        tops = mean[np.arange(n), best]
        a = int(tops.argmax())
        if not tops[a] >= threshold:
            break
        a, b = sorted((a, int(best[a])))
        row = (sizes[a] * mean[a] + sizes[b] * mean[b]) / (sizes[a] + sizes[b])
        row[[a, b]] = -np.inf
        mean[a] = mean[:, a] = row
        mean[b] = mean[:, b] = -np.inf
        sizes[a] += sizes[b]
        label[label == b] = a
        # rows whose best was one of the two look again; the others only at the merged one
        again = np.flatnonzero((best == a) | (best == b))
        best[again] = mean[again].argmax(1)
        best[a] = mean[a].argmax()
        at = np.arange(n)
        nearer = (row > mean[at, best]) | ((row == mean[at, best]) & (a < best))
        best[nearer] = a
    return label


def face_groups(faces: DataFrame, marks: DataFrame, known: DataFrame, threshold: float, per_pass: int | None = PER_PASS) -> DataFrame:
    """(id, embedding), (id, person) "is not this person", (person, embedding) -> (id, cluster: lowest id of the group, size).

    Faces are grouped by the average of their likenesses. Two faces stay apart if one is marked as not being a person whom the
    other resembles (the mean of its two best likenesses to that person's known faces reaches the threshold).

    ``per_pass`` None: all faces together, so no two groups are left whose mean reaches the threshold (``merged_whole``). A
    number: in passes of so many faces in id order that never merge with each other, as an application does that shows them."""
    placed = checkpointed(numbered(faces.select("id", "embedding"), [], ["id"]))
    # of equal vectors one is asked, and two of a person's are all that a mean of two can hold
    first = checkpointed(placed.where(_usable()).groupBy("embedding").agg(F.min("place").alias("first")))
    marks = marks.where("person is not null").select("id", "person").distinct()
    named = known.where(_usable()).join(marks.select("person").distinct(), "person", "left_semi").groupBy("person", "embedding").agg(F.count("*").alias("n"))
    named = checkpointed(named.select("person", "embedding", F.explode(F.sequence(F.lit(1), F.least(F.lit(2), F.col("n").cast("int"))))).drop("col"))
    resembles = rank_people(first.select(F.col("first").alias("id"), "embedding"), named).where(F.col("score") >= threshold)
    resembles = checkpointed(resembles.select(F.col("id").alias("first"), "person"))
    placed = checkpointed(placed.join(first, "embedding", "left"))
    if per_pass is None:
        return _grouped_whole(placed, marks, resembles, threshold)
    placed = placed.withColumn("pass", F.floor((F.col("place") - 1) / per_pass))
    alike = placed.select("id", "first").join(resembles, "first").select("id", "person", F.lit(False).alias("marked"))
    tags = marks.withColumn("marked", F.lit(True)).unionByName(alike)
    tags = tags.distinct().join(placed.select("id", "pass"), "id").select(*[F.col(c).alias(c) for c in ("pass", "id", "person", "marked")])

    def group(faces: pd.DataFrame, tags: pd.DataFrame) -> pd.DataFrame:
        if not len(faces):
            return pd.DataFrame({"id": [], "cluster": [], "size": []})
        faces = faces.sort_values("id", ignore_index=True)
        mean = likeness([np.zeros(0) if v is None else np.asarray(v) for v in faces["embedding"]])
        at = pd.Series(np.arange(len(faces)), faces["id"].to_numpy())
        for _, one in tags.groupby("person"):
            marked, alike = (at[one.loc[one["marked"] == is_mark, "id"]].to_numpy() for is_mark in (True, False))
            mean[np.ix_(marked, alike)] = -np.inf
            mean[np.ix_(alike, marked)] = -np.inf
        label = merge_groups(mean, threshold)
        return pd.DataFrame({"id": faces["id"], "cluster": faces["id"].to_numpy()[label], "size": np.bincount(label, minlength=len(label))[label]})

    return placed.select("pass", "id", "embedding").groupBy("pass").cogroup(tags.groupBy("pass")).applyInPandas(group, "id long, cluster long, size long")


def _square() -> Column:
    return F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def _usable() -> Column:
    """Whether a vector has a likeness with others of its length: it has numbers, all finite, as are their products."""
    return F.coalesce((F.size("embedding") > 0) & ~F.isnan(_square()) & (_square() < float("inf")), F.lit(False))


def _grouped_whole(placed: DataFrame, marks: DataFrame, resembles: DataFrame, threshold: float) -> DataFrame:
    """``face_groups`` of all faces together: (id, embedding, place, first: lowest place of the vector or null), (id, person), (first, person).

    Copies of a vector that is as long as any other of its numbers are each other's most alike, so they are one group from
    the start, unless a copy is marked as not being a person whom they resemble: it stays apart from every other copy."""
    none = F.array().cast(f"array<{marks.schema['person'].dataType.simpleString()}>")
    alike = resembles.groupBy("first").agg(F.collect_set("person").alias("alike"))
    marked = marks.groupBy("id").agg(F.collect_set("person").alias("marked"))
    faces = placed.where("first is not null").join(marked, "id", "left").join(alike, "first", "left")
    faces = faces.select("place", "first", "embedding", F.size("embedding").alias("length"), F.coalesce("marked", none).alias("marked"), F.coalesce("alike", none).alias("alike"), _square().alias("square"))
    longest = faces.groupBy("length").agg(F.max("square").alias("longest"))
    one = (F.col("square") >= F.col("longest") * (1 - 2e-6)) & (F.col("square") >= threshold) & ~F.arrays_overlap("marked", "alike")
    # a row for each length
    faces = checkpointed(faces.join(F.broadcast(longest), "length").withColumn("key", F.when(one, -F.col("first")).otherwise(F.col("place"))))
    groups = faces.groupBy("key").agg(
        F.min("place").alias("label"), F.first("length").alias("length"), F.count("*").alias("n"), F.first("embedding").alias("embedding"),
        F.array_distinct(F.flatten(F.collect_set("marked"))).alias("marked"), F.first("alike").alias("alike"),
    )
    groups = checkpointed(groups.withColumn("total", F.transform("embedding", lambda x: x.cast("double") * F.col("n"))).drop("embedding"))
    roots = merged_whole(groups.drop("key"), threshold)
    labels = placed.join(faces.select("place", "key"), "place", "left").join(groups.select("key", "label"), "key", "left").join(roots, "label", "left")
    labels = checkpointed(labels.select("id", "place", F.coalesce("root", "label", "place").alias("root")))
    sizes = labels.groupBy("root").agg(F.count("*").alias("size"))
    sizes = sizes.join(labels.select(F.col("place").alias("root"), F.col("id").alias("cluster")), "root")
    return labels.select("id", "root").join(sizes, "root").select(*[F.col(c).cast("long").alias(c) for c in ("id", "cluster", "size")])


def merged_whole(groups: DataFrame, threshold: float) -> DataFrame:
    """(label, length, n, total: sum of its n vectors, marked, alike: persons) -> (label, root) of those that went into another.

    What ``merge_groups`` does one by one, for any number of groups: two that are each other's best merge in one round with all
    such pairs, as no other merge comes before theirs: a merged group is at most as alike to a third as one of its two was. For
    the same reason one whose best is below the threshold is done, and one looks again only if its best has merged. A mean
    of likenesses is the product of two sums, so no likeness is kept. Rounds end once a task can hold what is left."""
    state = written(groups.withColumns({"best": F.lit(None).cast("long"), "score": F.lit(None).cast("double")}))
    merged = None
    while True:
        counts = state.groupBy("length").agg(F.count("*").alias("all"), F.count(F.when(F.col("best").isNull(), 1)).alias("asked"))
        held, most, asked = counts.agg(F.sum("all"), F.max(F.col("all") * F.col("length")), F.sum("asked")).first()
        if (most or 0) <= TOGETHER:
            break
        if asked:
            looked = _nearest(state.where("best is null"), state, asked, held).where(F.col("score") >= threshold)
            seen = state.where("best is null").drop("best", "score").join(looked, "label")
            state = written(state.where("best is not null").unionByName(seen))
        else:  # likenesses so close that each group's best has another one: the highest merges
            state = _highest_first(state)
        fate = written(_fates(state))
        gone = fate.where("keep < label").select("label", F.col("keep").alias("root"))
        merged = gone if merged is None else merged.unionByName(gone)
        state = written(_merged(state, fate))
    last = state.groupBy("length").applyInPandas(_finished(threshold), "label long, root long")
    return last if merged is None else _to_roots(merged.unionByName(last))


def _rows_of(tags: pd.Series) -> dict:
    """Person -> the rows that have it, ascending."""
    rows = np.repeat(np.arange(len(tags)), tags.map(len).to_numpy())
    return {person: rows[at] for person, at in pd.Series(rows).groupby(pd.Series([p for one in tags for p in one])).indices.items()} if len(rows) else {}


def _best_of(sums: np.ndarray, sizes: np.ndarray, itself: np.ndarray, tags: tuple[dict, dict], others: np.ndarray, counts: np.ndarray, theirs: tuple[dict, dict]):
    """For each group the row of the one among others of highest mean likeness, the first on ties, that mean, and the highest
    of the rest. Minus infinity where there is none. ``itself``: its own row among the others or -1; ``tags``, ``theirs``:
    rows by the persons that they are marked as and that they resemble."""
    means = (others / counts[:, None]).T
    best, score, rest = np.zeros(len(sums), np.int64), np.full(len(sums), -np.inf), np.full(len(sums), -np.inf)
    step = max(1, HELD_SCORES // len(others))
    for k in range(0, len(sums), step):
        here = np.arange(k, min(k + step, len(sums)))
        scores = (sums[here] / sizes[here, None]) @ means
        own = np.flatnonzero(itself[here] >= 0)
        scores[own, itself[here][own]] = -np.inf
        for mine, other in ((tags[0], theirs[1]), (tags[1], theirs[0])):
            for person in mine.keys() & other.keys():
                rows = mine[person]
                rows = rows[slice(*np.searchsorted(rows, (k, k + step)))] - k
                if len(rows):
                    scores[np.ix_(rows, other[person])] = -np.inf
        top, row = scores.max(1), np.arange(len(here))
        best[here] = at = (scores >= (top - TIE)[:, None]).argmax(1)
        scores[row, at] = -np.inf
        rest[here] = scores.max(1)
        # worked out in one order wherever a pair is met
        score[here] = np.where(top > -np.inf, np.round((sums[here] * others[at]).sum(1) / (sizes[here] * counts[at]), PLACES), -np.inf)
    return best, score, rest


def merge_nearest(sums: np.ndarray, sizes: np.ndarray, tags: tuple[dict, dict], best: np.ndarray, score: np.ndarray, threshold: float) -> np.ndarray:
    """The rounds of ``merged_whole`` in one task: each row's root. ``best``: the row of its best or -1, with its ``score``.

    A group whose best has merged looks again only if the merged one may be less alike than the rest were."""
    n = len(sums)
    sums, sizes, best, score, root, live = sums.copy(), sizes.astype(float), best.copy(), score.copy(), np.arange(n), np.arange(n)
    tags, rest, everyone = [dict(side) for side in tags], np.full(n, np.inf), np.arange(n)
    place = np.full(n, -1)

    def placed(rows: np.ndarray) -> list[dict]:
        place[:] = -1
        place[rows] = np.arange(len(rows))
        both = tags[0].keys() & tags[1].keys()
        return [{p: at[at >= 0] for p in both for at in [place[side[p]]]} for side in tags]

    while len(live):
        asked = live[best[live] < 0]
        if len(asked):
            mine, theirs = placed(asked), placed(live)
            found, score[asked], rest[asked] = _best_of(sums[asked], sizes[asked], place[asked], mine, sums[live], sizes[live], theirs)
            best[asked] = live[found]
            live = live[score[live] >= threshold]
            there = np.zeros(n, bool)
            there[live] = True
            lost = live[~there[best[live]]]
        else:  # as in _highest_first
            lost = live[:0]
            a, b = np.minimum(live, best[live]), np.maximum(live, best[live])
            k = np.lexsort((b, a, -score[live]))[0]
            best[a[k]], best[b[k]] = b[k], a[k]
        best[lost] = -1
        kept = live[(best[live] > live) & (best[best[live]] == live)]
        gone = best[kept]
        sums[kept] += sums[gone]
        sizes[kept] += sizes[gone]
        root[gone] = kept
        into = everyone.copy()
        into[gone] = kept
        for side in tags:
            for person, rows in side.items():
                side[person] = np.unique(into[rows])
        merged = np.zeros(n, bool)
        merged[kept] = merged[gone] = True
        live = live[into[live] == live]
        best[kept] = -1
        moved = live[(best[live] >= 0) & merged[best[live]]]
        best[moved] = into[best[moved]]
        score[moved] = np.round((sums[moved] * sums[best[moved]]).sum(1) / (sizes[moved] * sizes[best[moved]]), PLACES)
        for person in tags[0].keys() & tags[1].keys():
            marked, alike = (np.zeros(n, bool) for _ in range(2))
            marked[tags[0][person]], alike[tags[1][person]] = True, True
            score[moved[marked[moved] & alike[best[moved]] | alike[moved] & marked[best[moved]]]] = -np.inf
        best[moved[~((score[moved] > rest[moved] + TIE) & (score[moved] >= threshold))]] = -1
    while (root[root] != root).any():
        root = root[root]
    return root


def _nearest(asked: DataFrame, held: DataFrame, n_asked: int, n_held: int) -> DataFrame:
    """(label, best, score): of each asked group the one of highest mean likeness, the lowest on ties.

    Dealt to a grid as in ``rank_people``, but with more parts than blocks if few are asked, as then fewer rows are sent."""
    groups = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(groups, round((groups * n_held / n_asked) ** 0.5)), -(-n_held // BLOCK_ROWS))
    blocks = max(1, -(-groups // parts), -(-n_asked // BLOCK_ROWS))
    columns = ["label", "length", "n", "total", "marked", "alike"]
    left = asked.select(*columns, F.pmod(F.hash("label"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = held.select(*[F.col(c).alias(c) for c in columns], F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.hash("label"), F.lit(parts)).alias("part"))

    def best_of_part(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"label": [], "best": [], "score": []})
        held = held.sort_values("label", ignore_index=True)  # the first of equal ones is the lowest
        own, others = asked["label"].to_numpy(), held["label"].to_numpy()
        at = np.minimum(np.searchsorted(others, own), len(others) - 1)
        sides = [(np.stack(side["total"].to_numpy()), side["n"].to_numpy().astype(float), (_rows_of(side["marked"]), _rows_of(side["alike"]))) for side in (asked, held)]
        (sums, sizes, tags), rest = sides[0], sides[1]
        best, score, _ = _best_of(sums, sizes, np.where(others[at] == own, at, -1), tags, *rest)
        return pd.DataFrame({"label": own, "best": others[best], "score": score})[score > -np.inf]

    key = ["length", "block", "part"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(best_of_part, "label long, best long, score double")
    found = found.groupBy("label").agg(F.max("score").alias("score"), F.collect_list(F.struct("score", "best")).alias("all"))  # one of each part
    lowest = F.array_min(F.transform(F.filter("all", lambda x: x["score"] >= F.col("score") - TIE), lambda x: x["best"]))
    return found.select("label", lowest.alias("best"), "score")


def _highest_first(state: DataFrame) -> DataFrame:
    """``state`` with the two groups of the highest score, the lowest on ties, as each other's best."""
    a, b = F.least("label", "best"), F.greatest("label", "best")
    score, a, b = state.select("score", a.alias("a"), b.alias("b")).orderBy(F.desc("score"), "a", "b").first()
    return state.withColumn("best", F.when(F.col("label") == a, F.lit(b)).when(F.col("label") == b, F.lit(a)).otherwise(F.col("best")))


def _fates(state: DataFrame) -> DataFrame:
    """(label, keep: the lower of two that merge or itself, again: whether its best is no more what it was)."""
    own = state.select("label", "best")
    back = own.select(F.col("label").alias("best"), F.col("best").alias("back"))
    own = own.join(back, "best", "left").withColumn("merges", F.coalesce(F.col("back") == F.col("label"), F.lit(False)))
    other = own.select(F.col("label").alias("best"), F.col("merges").alias("moves"))
    keep = F.when(F.col("merges"), F.least("label", "best")).otherwise(F.col("label"))
    return own.join(other, "best", "left").select("label", keep.alias("keep"), F.coalesce("moves", F.lit(True)).alias("again"))


def _merged(state: DataFrame, fate: DataFrame) -> DataFrame:
    """The groups after a round, of which those that merged or whose best did have none."""
    both = state.join(fate, "label").groupBy("keep").agg(
        F.first("length").alias("length"), F.sum("n").alias("n"), F.collect_list("total").alias("totals"),
        *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("marked", "alike")],
        *[F.max(F.when(~F.col("again"), F.col(c))).alias(c) for c in ("best", "score")],
    )
    total = F.when(F.size("totals") == 1, F.col("totals")[0]).otherwise(F.zip_with(F.col("totals")[0], F.try_element_at("totals", F.lit(2)), lambda x, y: x + y))
    return both.select(F.col("keep").alias("label"), "length", "n", total.alias("total"), "marked", "alike", "best", "score")


def _finished(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Merges what is left of vectors of one length."""

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("label", ignore_index=True)
        labels, wanted = rows["label"].to_numpy(), rows["best"].fillna(-1).to_numpy().astype(np.int64)
        best = np.minimum(np.searchsorted(labels, wanted), len(labels) - 1)
        best = np.where(labels[best] == wanted, best, -1)
        tags = _rows_of(rows["marked"]), _rows_of(rows["alike"])
        root = labels[merge_nearest(np.stack(rows["total"].to_numpy()), rows["n"].to_numpy(), tags, best, rows["score"].to_numpy().astype(float), threshold)]
        return pd.DataFrame({"label": labels, "root": root})[root != labels]

    return finish


def _to_roots(merged: DataFrame) -> DataFrame:
    """(label, root): where each ends, its root's root and so on; ways halve with each look."""
    merged = written(merged)
    while True:
        up = merged.select(F.col("label").alias("root"), F.col("root").alias("up"))
        merged = written(merged.select("label", "root").join(up, "root", "left"))
        moved = not merged.where("up is not null").isEmpty()
        merged = merged.select("label", F.coalesce("up", "root").alias("root"))
        if not moved:
            return merged


def largest_groups(groups: DataFrame, limit: int = 40, least: int = 2) -> DataFrame:
    """The faces of the ``limit`` largest groups of at least ``least`` faces, with the group's place: by size, then lowest id."""
    first = groups.where((F.col("id") == F.col("cluster")) & (F.col("size") >= least)).orderBy(F.desc("size"), "cluster").limit(limit)
    ranked = first.agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("less"), "cluster"))).alias("all"))  # at most ``limit`` rows
    ranked = ranked.select(F.posexplode("all").alias("place", "one")).select((F.col("place") + 1).cast("long").alias("place"), "one.cluster")
    return groups.join(F.broadcast(ranked), "cluster").select("place", "cluster", "size", "id")


def _overlaps(regions: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """Pairs of one photo that overlap enough: (photo, region, detection, iou)."""
    r, d = (rows.select("photo", "id", *BOX).alias(name) for rows, name in ((regions, "r"), (found, "d")))
    iou = overlap(*({c: F.col(f"{side}.{c}").cast("double") for c in BOX} for side in ("r", "d")))
    pairs = r.join(d, F.col("r.photo") == F.col("d.photo")).select(F.col("r.photo").alias("photo"), F.col("r.id").alias("region"), F.col("d.id").alias("detection"), iou.alias("iou"))
    return pairs.where(F.col("iou") >= least)


def lend_landmarks(regions: DataFrame, found: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """(photo, id, x0, y0, x1, y1) twice -> (photo, region, detection, iou): for each region the detection that overlaps it
    most, the first of equal ones; one detection can serve several regions. Regions without one aren't there."""
    best = _overlaps(regions, found, least).groupBy("photo", "region").agg(F.min(F.struct((-F.col("iou")).alias("less"), "detection")).alias("best"))
    return best.select("photo", "region", "best.detection", (-F.col("best.less")).alias("iou"))


def match_regions(regions: DataFrame, found: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """As ``lend_landmarks``, but one to one: pairs are taken by descending overlap (ties by region, then detection), and
    each takes its two out. A pair that is the best of both sides can be taken at once, so all such pairs of all photos are
    taken in one round, and the rounds are as many as the longest chain of faces that wait for each other."""
    pairs = checkpointed(_overlaps(regions, found, least))
    taken = None
    while not pairs.isEmpty():
        rank = F.struct((-F.col("iou")).alias("less"), "region", "detection")
        of_region = pairs.groupBy("photo", "region").agg(F.min(rank).alias("best_r"))
        of_detection = pairs.groupBy("photo", "detection").agg(F.min(rank).alias("best_d"))
        mutual = pairs.join(of_region, ["photo", "region"]).join(of_detection, ["photo", "detection"]).where(F.col("best_r") == F.col("best_d"))
        mutual = checkpointed(mutual.select("photo", "region", "detection", "iou"))
        taken = mutual if taken is None else taken.unionAll(mutual)
        pairs = pairs.join(mutual.select("photo", "region"), ["photo", "region"], "left_anti")
        pairs = checkpointed(pairs.join(mutual.select("photo", "detection"), ["photo", "detection"], "left_anti"))
    return pairs if taken is None else taken


def fit_similarity(points: DataFrame, key: str) -> DataFrame:
    """(key, px, py, qx, qy) -> (key, re, im, tx, ty): the turn, scale and shift that take each group's points p closest to
    its points q, by least squares; q = (re + i im) p + t over complex numbers, so nothing is mirrored. Null where points
    don't determine it: fewer than two, all at one place, or one that isn't finite. All sums are built-in aggregates."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    sums = points.groupBy(key).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("px", "py", "qx", "qy")],
        (F.covar_pop("px", "qx") + F.covar_pop("py", "qy")).alias("same"), (F.covar_pop("px", "qy") - F.covar_pop("py", "qx")).alias("turned"),
        (F.var_pop("px") + F.var_pop("py")).alias("norm"),
    )
    fits = (F.col("n") >= 2) & finite(F.col("norm")) & (F.col("norm") * F.col("n") > 1e-9)
    re, im = F.try_divide("same", "norm"), F.try_divide("turned", "norm")
    tx, ty = F.col("qx") - (re * F.col("px") - im * F.col("py")), F.col("qy") - (re * F.col("py") + im * F.col("px"))
    fits = fits & finite(re) & finite(im) & finite(tx) & finite(ty)
    return sums.select(key, *[F.when(fits, c).alias(name) for name, c in (("re", re), ("im", im), ("tx", tx), ("ty", ty))])


def rect_key(box: dict[str, Column] | None = None) -> Column:
    """A rectangle as it is looked up: its corners in steps of a ten-thousandth."""
    box = box or {c: F.col(c) for c in BOX}
    return F.concat_ws(",", *[F.round(box[c] * 10_000).cast("long").cast("string") for c in BOX])
