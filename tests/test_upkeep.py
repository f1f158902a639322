"""Pairs, repair, settings, faces, rules over albums and places in lists against brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from photolith.operators import faces, models, numbering, pairing, repair, rules, settings
from photolith.operators.vectors import rank_people
from photolith.streaming import faces as stream
from photolith.streaming import logs

NOW = "2024-06-01T00:00:00"


# ---- places in lists


@pytest.mark.parametrize("hot", [0.1, 0.9])
def test_places_in_long_lists(spark, hot):
    rng = random.Random(hot)
    rows = [(k, "a" if rng.random() < hot else rng.choice(["b", None]), rng.choice([None, 1, 1, 2, 5])) for k in rng.sample(range(10**6), 800)]
    frame = spark.createDataFrame(rows, "id long, list string, v int").repartition(5)
    got = {r["id"]: r["place"] for r in numbering.numbered(frame, ["list"], ["v", "id"]).collect()}
    for name in ("a", "b", None):
        listed = sorted((r for r in rows if r[1] == name), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert [got[r[0]] for r in listed] == list(range(1, len(listed) + 1))
    whole = {r["id"]: r["place"] for r in numbering.numbered(frame, [], ["id"]).collect()}
    assert [i for i, _ in sorted(whole.items(), key=lambda x: x[1])] == sorted(r[0] for r in rows)
    assert numbering.numbered(frame.limit(0), ["list"], ["id"]).count() == 0


def test_ranges_are_even(spark):
    frame = spark.range(0, 8000).select((F.col("id") * 7919 % 8000).alias("id"), F.lit("x").alias("list"))
    sizes = [r["count"] for r in frame.withColumn("r", numbering.range_of(frame, ["list", "id"], 8)).groupBy("r").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2000


# ---- rules over albums


def brute_holds(albums, row, album, memo, stack):
    """One photo and album, answers kept for the question; every rule is looked at."""
    if album in memo:
        return memo[album]
    if album not in albums or album in stack or len(stack) >= rules.DEEPEST:
        return False
    found = brute_rules(albums, row, albums[album], memo, (*stack, album)) and not row["deleted"]
    memo[album] = found
    return found


def brute_rules(albums, row, told, memo, stack):
    tests = []
    for r in told["rules"]:
        if "group" in r:
            tests.append(brute_rules(albums, row, r["group"], memo, stack))
        elif r["field"] == "album":
            holds = brute_holds(albums, row, r["value"], memo, stack)
            tests.append(holds == (r["op"] == "is"))
        else:
            tests.append(row["rating"] >= r["value"])
    return {"all": all, "any": any, "none": lambda t: not any(t)}[told["match"]](tests) if tests else told["match"] != "any"


def random_rules(rng, known, depth=0):
    out = []
    for _ in range(rng.randint(1, 3)):
        kind = rng.random()
        if kind < 0.5:
            out.append({"field": "album", "op": rng.choice(["is", "isNot"]), "value": rng.choice(known)})
        elif kind < 0.8 or depth:
            out.append({"field": "rating", "op": "gte", "value": rng.randint(0, 5)})
        else:
            out.append({"group": random_rules(rng, known, 1)})
    return {"match": rng.choice(["all", "any", "none"]), "rules": out}


def test_rules_over_albums_that_name_each_other(spark):
    photos = spark.createDataFrame([(k, k % 6, k % 13 == 5, False) for k in range(60)], "id long, rating int, deleted boolean, local boolean")
    rows = photos.collect()
    rng = random.Random(8)
    for turn in range(8):
        n = 7
        known = [*range(n), 99]
        # from the first four turns without loops
        albums = {k: random_rules(rng, [a for a in known if a > k] if turn < 4 else known) for k in range(n)}
        wanted = random_rules(rng, known)
        got = sorted(r["id"] for r in rules.select(photos, wanted, NOW, albums).collect())
        want = [r["id"] for r in rows if not r["deleted"] and brute_rules(albums, r, wanted, {}, ())]
        assert got == want, (turn, albums, wanted)


def test_chains_are_cut_at_the_deepest_album(spark):
    photos = spark.createDataFrame([(1, 5, False, False)], "id long, rating int, deleted boolean, local boolean")
    one = lambda k: {"match": "all", "rules": [{"field": "album", "op": "is", "value": k}]}
    for n, want in ((rules.DEEPEST, 1), (rules.DEEPEST + 1, 0)):
        albums = {k: one(k + 1) for k in range(1, n)} | {n: {"match": "all", "rules": []}}
        assert rules.select(photos, one(1), NOW, albums).count() == want


def test_an_album_named_often_is_one_column(spark):
    photos = spark.createDataFrame([(k, k % 6, False, False) for k in range(12)], "id long, rating int, deleted boolean, local boolean")
    twice = lambda k: {"match": "any", "rules": [{"field": "album", "op": "is", "value": k}, {"field": "album", "op": "is", "value": k}]}
    albums = {k: twice(k + 1) for k in range(1, 24)} | {24: {"match": "all", "rules": [{"field": "rating", "op": "gte", "value": 3}]}}
    found, _ = rules.RuleCompiler(NOW, albums).over(photos, twice(1))
    assert [c for c in found.columns if c.startswith("_album_")] == [f"_album_{k}" for k in range(24, 0, -1)]
    assert sorted(r["id"] for r in rules.select(photos, twice(1), NOW, albums).collect()) == [3, 4, 5, 9, 10, 11]


# ---- pairs of files


def brute_pairs(rows):
    def parts(path):
        folder, name = path.rsplit("/", 1)
        stem = name.rsplit(".", 1)[0] if "." in name[1:] else name
        return folder, stem

    used, out = set(), []
    for raw in sorted((r for r in rows if r["kind"] == "raw"), key=lambda r: (r["path"], r["id"])):
        for jpeg in sorted((r for r in rows if r["kind"] == "image" and r["path"].lower().endswith((".jpg", ".jpeg"))), key=lambda r: r["path"]):
            (rf, rs), (jf, js) = parts(raw["path"]), parts(jpeg["path"])
            if jpeg["id"] in used or rs != js or not raw["captured"] or raw["captured"] != jpeg["captured"]:
                continue
            a, b = raw["camera"] or "", jpeg["camera"] or ""
            if a and b and a != b:
                continue
            size = raw["width"] and raw["height"] and (raw["width"], raw["height"]) == (jpeg["width"], jpeg["height"])
            if rf == jf:
                relation = "sameFolder"
            elif jf.rsplit("/", 1)[0] == rf and ((a and b) or size):
                relation = "directExport"
            else:
                continue
            used.add(jpeg["id"])
            out.append((raw["id"], jpeg["id"], relation))
    return sorted(out)


FILE = "id long, path string, kind string, captured string, camera string, width int, height int"


def test_pairs_of_files(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        raw = rng.random() < 0.4
        folder = rng.choice(["/s", "/s/x", "/s/x/out", "/s/x/out/deep", "/t", "/t/out"])
        path = f"{folder}/{rng.choice(['A', 'B.1', '.c', 'D'])}.{rng.choice(['cr3', 'RAF']) if raw else rng.choice(['jpg', 'JPEG', 'png'])}"
        rows.append((k, path, "raw" if raw else "image", rng.choice([None, "t1", "t2"]), rng.choice([None, "", "X", "Y"]), rng.choice([0, 10, 20]), rng.choice([None, 10])))
    got = sorted(tuple(r) for r in pairing.raw_jpeg_relations(spark.createDataFrame(rows, FILE)).collect())
    want = brute_pairs([dict(zip(("id", "path", "kind", "captured", "camera", "width", "height"), r, strict=True)) for r in rows])
    assert got == want and {r for _, _, r in want} == {"sameFolder", "directExport"}


def test_many_files_of_one_shot_make_no_pairs_of_all(spark):
    rows = [(k, f"/s/A.{'cr3' if k % 2 else 'jpg'}", "raw" if k % 2 else "image", "t", "X", 1, 1) for k in range(4000)]
    found = pairing.raw_jpeg_relations(spark.createDataFrame(rows, FILE))
    assert found.count() == 2000 and found.where("raw_id <> 1").isEmpty()


# ---- repair


def brute_repair(photos, albums, stacks, members):
    changes = []
    here = set(photos)
    kept = {}
    for s in sorted(stacks):
        seen, left = set(), []
        listed = [p for _, p in sorted((pos, p) for t, pos, p in members if t == s)]
        for p in listed:
            if p in here and p not in seen:
                seen.add(p)
                left.append(p)
        if len(left) != len(listed):
            changes.append(("stack", s, "missing or repeated photos left out", len(listed) - len(left)))
        if len(left) < 2:
            changes.append(("stack", s, "fewer than two photos: removed", len(left)))
        else:
            kept[s] = left
    stacked, out = set(), {}
    for s, left in sorted(kept.items()):
        stay = []
        for p in left:
            if p not in stacked:
                stacked.add(p)
                stay.append(p)
        if len(stay) != len(left):
            changes.append(("stack", s, "photos in another stack left out", len(left) - len(stay)))
        if len(stay) >= 2:
            out[s] = stay
    parent, folder = {i: p for i, p, _ in albums}, {i: f for i, _, f in albums}
    for i in sorted(parent):
        if parent[i] is None:
            continue
        at, steps, fine = parent[i], 0, None
        while fine is None:
            if at is None:
                fine = True
            elif at == i or steps > len(parent) or not folder.get(at):
                fine = False
            else:
                at, steps = parent[at], steps + 1
        if not fine:
            changes.append(("album", i, "moved to the top", parent[i]))
            parent[i] = None
    return out, parent, sorted(changes)


@pytest.mark.parametrize("seed", range(4))
def test_repair_of_a_damaged_catalog(spark, seed):
    rng = random.Random(seed)
    photos = rng.sample(range(60), 40)
    n = rng.choice([5, 14])
    albums = [(i, rng.choice([None, *range(n + 1)]), rng.random() < 0.8) for i in range(n)]
    stacks = list(range(0, 30, 2))
    members = [(rng.randrange(0, 32), pos, rng.randrange(60)) for pos in range(150)]
    counters = [("photo", 3), ("album", 1000), ("stack", 3)]
    frame = spark.createDataFrame
    given = repair.Catalog(
        frame([(p, p if p % 9 else p + 1) for p in photos], "filed long, id long"), frame([(i, i, p, f) for i, p, f in albums], "filed long, id long, parent long, folder boolean"),
        frame([(s, None if s == 4 else s) for s in stacks], "filed long, id long"), frame(members, "stack long, pos long, photo long"), frame(counters, "kind string, next long"),
    )
    mended, changes = repair.repair(given)
    stacked, parent, want = brute_repair(photos, albums, stacks, members)
    got = {}
    for r in sorted(mended.members.collect(), key=lambda r: r["pos"]):
        got.setdefault(r["stack"], []).append(r["photo"])
    assert got == stacked and sorted(r["id"] for r in mended.stacks.collect()) == sorted(stacked)
    assert {r["id"]: r["parent"] for r in mended.albums.collect()} == parent
    assert sorted(r["id"] for r in mended.photos.collect()) == sorted(photos)
    want += [("photo", p, "filed as another id", 1) for p in photos if p % 9 == 0] + [("stack", 4, "filed as another id", 1)]
    past = {"photo": max(photos) + 1, "album": n, "stack": max(stacked, default=0) + 1}
    want += [("counter", None, f"{k} ids passed", past[k]) for k, have in counters if past[k] > have]
    assert sorted(map(tuple, changes.collect()), key=str) == sorted(want, key=str)
    assert {r["kind"]: r["next"] for r in mended.counters.collect()} == {k: max(have, past[k]) for k, have in counters}


# ---- settings


def brute_merge(base, patch):
    if not (isinstance(base, dict) and isinstance(patch, dict)):
        return patch
    return base | {k: brute_merge(base[k], v) if isinstance(base.get(k), dict) and isinstance(v, dict) else v for k, v in patch.items()}


def random_patch(rng, depth=0):
    if depth and rng.random() < 0.45 or depth > 3:
        return rng.choice([None, 1, 2.5, "x", True, [1, {"a": 2}], {}])
    return {k: random_patch(rng, depth + 1) for k in rng.sample("abc", rng.randint(0, 2))}


def test_settings_merge_in_order(spark):
    rng = random.Random(12)
    patches, want = [], {}
    for key in range(60):
        state = None
        for seq in range(rng.randint(1, 9)):
            patch = random_patch(rng) if rng.random() < 0.95 else rng.choice([5, None])
            state = patch if seq == 0 else brute_merge(state, patch)
            patches.append((key, seq * 10, json.dumps(patch)))
        want[key] = state
    patches += [(0, 10**6, None), (0, 10**6 + 1, "{not json"), (777, 1, None)]
    rng.shuffle(patches)
    got = {r["key"]: json.loads(r["settings"]) for r in settings.deep_merge(spark.createDataFrame(patches, "key long, seq long, patch string")).collect()}
    assert got == want


# ---- faces


def brute_groups(rows, marks, resembles, threshold, per_pass):
    out = {}
    rows = sorted(rows)
    for at in range(0, len(rows), per_pass):
        part = rows[at : at + per_pass]
        n = len(part)
        mean = np.full((n, n), -np.inf)
        usable = [v is not None and len(v) > 0 and np.isfinite(v).all() for _, v in part]
        tags = [({p for i, p in marks if i == part[k][0]}, {p for i, p in resembles if i == part[k][0]}) for k in range(n)]
        for i in range(n):
            for j in range(n):
                if i != j and usable[i] and usable[j] and len(part[i][1]) == len(part[j][1]) and not (tags[i][0] & tags[j][1] or tags[j][0] & tags[i][1]):
                    mean[i, j] = float(np.dot(np.asarray(part[i][1], float), np.asarray(part[j][1], float)))
        groups = {k: [k] for k in range(n)}
        while True:
            a, b = divmod(int(np.argmax(mean)), n)
            if not mean[a, b] >= threshold:
                break
            x, y = len(groups[a]), len(groups[b])
            row = (x * mean[a] + y * mean[b]) / (x + y)
            mean[a], mean[:, a] = row, row
            mean[b], mean[:, b], mean[a, a] = -np.inf, -np.inf, -np.inf
            groups[a] += groups.pop(b)
        for members in groups.values():
            for k in members:
                out[part[k][0]] = (part[min(members)][0], len(members))
    return out


def test_groups_of_faces_over_two_passes(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 16))
    ids = sorted(rng.choice(10**7, 1500, replace=False).tolist())
    vectors = centres[rng.integers(0, 60, 1500)] + 0.6 * rng.normal(size=(1500, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in zip(ids, vectors, strict=True)]
    rows[3], rows[4], rows[5], rows[1200] = (ids[3], None), (ids[4], [float("nan")] * 16), (ids[5], [1.0, 0.0]), (ids[1200], [])
    known = [(f"p{k % 5}", (centres[k % 5] / np.linalg.norm(centres[k % 5])).astype(np.float32).tolist()) for k in range(12)]
    marks = [(ids[k], f"p{k % 5}") for k in range(0, 1500, 3)]
    frame = spark.createDataFrame
    given = frame(rows, "id long, embedding array<float>"), frame(marks, "id long, person string"), frame(known, "person string, embedding array<float>")
    got = {r["id"]: (r["cluster"], r["size"]) for r in faces.face_groups(*given, 0.55).collect()}
    resembles = set()
    for i, v in rows:
        if v is not None and len(v) == 16 and np.isfinite(v).all():
            for person in {p for p, _ in known}:
                best = sorted((float(np.dot(v, w)) for p, w in known if p == person), reverse=True)[:2]
                if np.mean(best) >= 0.55:
                    resembles.add((i, person))
    want = brute_groups(rows, marks, resembles, 0.55, 1000)
    assert got == want and max(s for _, s in want.values()) > 5 and resembles
    listed = faces.largest_groups(faces.face_groups(*given, 0.55), 7).collect()
    tops = sorted({(-s, c) for c, s in want.values() if s >= 2})[:7]
    assert {(r["place"], r["cluster"], r["size"], r["id"]) for r in listed} == {(k + 1, c, -s, i) for k, (s, c) in enumerate(tops) for i, x in want.items() if x[0] == c}


def test_groups_keep_marked_faces_apart():
    mean = faces.likeness([np.array([1.0, 0.0])] * 4)
    mean[0, 3] = mean[3, 0] = -np.inf
    assert faces.merge_groups(mean, 0.5).tolist() == [0, 0, 0, 3]
    assert faces.merge_groups(np.zeros((0, 0)), 0.5).tolist() == []


def test_people_are_ranked_among_vectors_of_one_length(spark):
    unknown = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id long, embedding array<float>")
    known = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0]), ("a", [0.0, 1.0])], "person string, embedding array<float>")
    assert sorted(tuple(r) for r in rank_people(unknown, known).collect()) == [(1, "a", 0.5, 2), (2, "b", 1.0, 1)]


BOXES = "photo long, id long, x0 double, y0 double, x1 double, y1 double"


def test_regions_are_matched_one_to_one(spark):
    rng = random.Random(2)

    def box(photo, k):
        x, y = rng.choice([0.0, 0.1, 0.2, 0.3]), rng.choice([0.0, 0.1, 0.2])
        return (photo, k, x, y, x + 0.5, y + 0.5)

    regions = [box(p, k) for p in range(40) for k in range(rng.randint(0, 6))] + [(99, 1, None, 0.0, 1.0, 1.0)]
    found = [box(p, 100 + k) for p in range(40) for k in range(rng.randint(0, 6))]
    frame = spark.createDataFrame
    got = sorted((r["photo"], r["region"], r["detection"]) for r in faces.match_regions(frame(regions, BOXES), frame(found, BOXES)).collect())
    lent = sorted((r["photo"], r["region"], r["detection"]) for r in faces.lend_landmarks(frame(regions, BOXES), frame(found, BOXES)).collect())

    def iou(a, b):
        if a[2] is None:
            return 0
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        both = max(w, 0) * max(h, 0)
        return both / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - both)

    pairs = sorted((-iou(r, d), r[1], d[1], r[0]) for r in regions for d in found if r[0] == d[0] and iou(r, d) >= 0.3)
    want, used = [], set()
    for _, r, d, p in pairs:
        if (p, "r", r) not in used and (p, "d", d) not in used:
            used |= {(p, "r", r), (p, "d", d)}
            want.append((p, r, d))
    assert got == sorted(want)
    first = {}
    for _, r, d, p in pairs:
        first.setdefault((p, r), d)
    assert lent == sorted((p, r, d) for (p, r), d in first.items())


def test_alignment_of_points(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for k in range(20):
        p = rng.normal(size=5) + 1j * rng.normal(size=5)
        a, t = complex(*rng.normal(size=2)) * 30, complex(*rng.normal(size=2))
        want[k] = (a.real, a.imag, t.real, t.imag)
        rows += [(k, *map(float, (z.real, z.imag, (a * z + t).real, (a * z + t).imag))) for z in p]
    rows += [(50, 1.0, 1.0, 2.0, 2.0)] * 3 + [(51, 1.0, 2.0, 3.0, 4.0), (52, float("nan"), 0.0, 0.0, 0.0), (52, 1.0, 0.0, 0.0, 0.0)]
    got = {r["key"]: tuple(r)[1:] for r in faces.fit_similarity(spark.createDataFrame(rows, "key long, px double, py double, qx double, qy double"), "key").collect()}
    for k, w in want.items():
        assert np.allclose(got[k], w, atol=1e-9)
    assert got[50] == got[51] == got[52] == (None,) * 4


SCAN = "photo long, version long, x0 double, y0 double, x1 double, y1 double, embedding array<float>"


def test_face_index_grows_with_its_folder(spark, tmp_path):
    rng = random.Random(6)
    scans = [(p, v, None if rng.random() < 0.1 else rng.randint(0, 4) / 4, 0.0, 1.0, 1.0, [3.0, 4.0]) for p in range(30) for v in (1, 2, 3)[: rng.randint(1, 3)] for _ in range(rng.randint(1, 4))]
    rng.shuffle(scans)
    source = tmp_path / "scans"

    def run(part):
        spark.createDataFrame(part, SCAN).coalesce(1).write.mode("append").parquet(str(source))
        found = stream.run_index(spark.readStream.schema(SCAN).parquet(str(source)), spark, str(tmp_path / "index"))
        return sorted((r["photo"], r["version"], r["key"], r["score"]) for r in found.collect())

    for upto in (len(scans) // 3, len(scans)):
        got = run(scans[: len(scans) // 3] if upto < len(scans) else scans[upto // 3 :])
        now = sorted((r["photo"], r["version"], r["key"], 5.0) for r in stream.scans_now(spark.createDataFrame(scans[:upto], SCAN)).collect())
        assert got == now


def test_files_that_come_again_or_were_deleted(spark, tmp_path):
    library = spark.createDataFrame([(1, "/a", False), (2, "/b", True), (3, "/c", True), (4, "/c", False)], "id long, path string, deleted boolean")

    def run(*paths):
        spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "id long, path string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream_ = spark.readStream.schema("id long, path string").parquet(str(tmp_path / "in"))
        return sorted((r["path"], r["outcome"]) for r in logs.run_arrivals(stream_, library, str(tmp_path / "out")).collect())

    first = [("/a", "known"), ("/b", "deleted"), ("/n", "new")]
    assert run("/a", "/b", "/n", "/n") == first
    assert run("/n", "/c", "/b", "/m") == sorted([*first, ("/c", "known"), ("/m", "new")])


# ---- ridge


def test_ridge_is_the_loop_over_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(*map(float, rng.normal(size=3)), float(rng.normal()), float(rng.random() + 0.1)) for _ in range(60)]
    frame = spark.createDataFrame([*rows, (None, 0.0, 0.0, 1.0, 1.0), (float("nan"), 0.0, 0.0, 1.0, 1.0)], "a double, b double, c double, y double, w double").repartition(4)
    got = models.fit_ridge(frame, ["a", "b", "c"], "y", "w")
    c = [0.0] * 4
    for _ in range(models.PASSES):
        for j in range(4):
            rho = norm = 0.0
            for r in rows:
                x = (1.0, *r[:3])
                said = c[0] + sum(c[k] * x[k] for k in range(4) if k != j)
                rho += r[4] * x[j] * (r[3] - said)
                norm += r[4] * x[j] ** 2
            c[j] = rho / (norm + (models.PENALTY if j else 0.0))
    assert np.allclose([got[k] for k in ("", "a", "b", "c")], c, rtol=1e-8)
