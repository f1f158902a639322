"""The grid filter: a record of optional constraints, compiled to one conjunction of columns.

Plain comparisons stay unwrapped, so that they reach the scan; a null conjunct drops its row, as it should. Only what
stands under a negation is made two-valued first.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photolith.functions.geo import distance_m
from photolith.functions.names import is_under, people


@dataclass(frozen=True)
class Filter:
    """Fields that are None, empty or 0 constrain nothing; ``deleted`` always does."""

    text: str = ""
    rating: int = 0
    rating_op: str = "atLeast"
    flag: str | None = None
    label: str | None = None
    labels: tuple[str, ...] = ()
    only: DataFrame | None = None
    kind: str | None = None
    edited: bool | None = None
    album: DataFrame | None = None
    deleted: bool = False
    date: str | None = None
    library_folder: str | None = None
    keyword: str | None = None
    person: str | None = None
    camera: str | None = None
    lens: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    imported: str | None = None
    imported_from: str | None = None
    merged: str | None = None
    folder: str | None = None
    subfolders: bool = False
    saved_location: tuple[float, float, float] | None = None
    has_gps: bool | None = None
    named_place: bool | None = None
    rule_set: Column | None = None


def has_person(name: str) -> Column:
    return F.exists(people(F.col("names")), lambda n: F.lower(n) == name.strip().lower())


def has_keyword(path: str) -> Column:
    return F.exists("keywords", lambda k: is_under(k, path))


def merged_kind(file_name: Column) -> Column:
    """hdr, panorama or hdrPanorama by the end of the stem, digits, dashes and blanks aside; else null."""
    stem = F.regexp_replace(F.lower(F.regexp_replace(file_name, r"\.[^.]*$", "")), r"[0-9\- ]+$", "")
    return F.when(stem.endswith("-hdr-pano"), "hdrPanorama").when(stem.endswith("-hdr"), "hdr").when(stem.endswith("-pano"), "panorama")


def named_place() -> Column:
    return F.trim(F.concat("location", "city", "state", "country")) != ""


def in_folder(path: Column, folder: str, below: bool) -> Column:
    """A file directly in ``folder``, or anywhere below; both slashes separate."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    root = folder.replace("\\", "/").rstrip("/") + "/"
    inside = clean.startswith(root)
    return inside if below else inside & (F.instr(F.substring(clean, len(root) + 1, 1 << 20), "/") == 0)


def folder_key(path: str) -> str:
    """A folder's identity: one kind of slash, without ``.`` and ``..`` and a trailing slash, drive letters in upper case."""
    clean = re.sub(r"^//[?.]/", "", path.replace("\\", "/"))
    unc, rooted = clean.startswith("//"), clean.startswith("/")
    levels: list[str] = []
    for level in clean.split("/"):
        if level == "..":
            if levels:
                levels.pop()
        elif level not in ("", "."):
            levels.append(level)
    if levels and re.fullmatch(r"[a-zA-Z]:", levels[0]):
        levels[0] = levels[0].upper()
    return ("//" if unc else "/" if rooted else "") + "/".join(levels)


def _number(have: Column, value: str) -> Column:
    """``>3``, ``<3``, ``=3`` or ``3``; what is no number matches nothing."""
    match = re.fullmatch(r"([<>=]?)([-+]?(?:\d+\.?\d*|\.\d+)(?:e[-+]?\d+)?)", value)
    if not match:
        return F.lit(False)
    want = float(match[2])
    return {">": have > want, "<": have < want}.get(match[1], F.abs(have - want) < 1e-9)


def _flag(value: str) -> Column:
    known = {"pick": "pick", "picked": "pick", "reject": "reject", "rejected": "reject", "none": "none", "unflagged": "none"}
    return F.col("flag") == known[value] if value in known else F.lit(False)


def _truth(have: Column) -> Callable[[str], Column]:
    return lambda value: have == (value in ("true", "yes"))


_FIELDS: dict[str, Callable[[str], Column]] = {
    "rating": lambda v: _number(F.col("rating"), v),
    "flag": _flag,
    "label": lambda v: F.col("label") == v,
    "iso": lambda v: _number(F.col("iso"), v),
    "aperture": lambda v: _number(F.col("aperture"), v),
    "focal": lambda v: _number(F.col("focal"), v),
    "camera": lambda v: F.contains(F.lower("camera"), F.lit(v)),
    "lens": lambda v: F.contains(F.lower("lens"), F.lit(v)),
    "keyword": has_keyword,
    "person": has_person,
    "type": lambda v: F.col("kind") == v,
    "edited": lambda v: _truth(F.col("is_edited"))(v),
    "date": lambda v: F.col("captured").startswith(v),
    "copy": lambda v: _truth(F.col("copy_of").isNotNull())(v),
    "name": lambda v: F.contains(F.lower("file_name"), F.lit(v)),
}
_ALIASES = {"stars": "rating", "color": "label", "f": "aperture", "kw": "keyword", "who": "person", "kind": "type", "virtual": "copy", "file": "name"}
SEARCHED = ("file_name", "title", "caption", "camera", "lens", "location", "format")


def token_matches(token: str) -> Column:
    """One token of the free text: ``field:value``, or a part of any of the searched texts or keywords."""
    token = token.lower()
    field, colon, value = token.partition(":")
    if colon:
        compile_field = _FIELDS.get(_ALIASES.get(field, field))
        return compile_field(value) if compile_field else F.lit(False)
    texts = [F.contains(F.lower(c), F.lit(token)) for c in SEARCHED]
    return reduce(lambda a, b: a | b, texts) | F.exists("keywords", lambda k: F.contains(F.lower(k), F.lit(token)))


def conjuncts(f: Filter) -> list[Column]:
    """The constraints of a filter, those on plain columns first."""
    found: list[Column] = [F.col("deleted") == f.deleted]
    if f.folder is not None:
        found.append(in_folder(F.col("path"), f.folder, f.subfolders))
    elif not f.deleted:
        found.append(~F.col("local"))
    if f.rating:
        have = F.col("rating")
        found.append({"atLeast": have >= f.rating, "exactly": have == f.rating, "atMost": have <= f.rating}[f.rating_op])
    for column, value in (("flag", f.flag), ("label", f.label), ("kind", f.kind), ("is_edited", f.edited)):
        if value is not None:
            found.append(F.col(column) == value)
    if f.labels:
        found.append(F.col("label").isin(*f.labels))
    if f.date_from is not None:
        found.append(F.col("captured") >= f.date_from)
    if f.date_to is not None:
        found.append(F.substring("captured", 1, len(f.date_to)) <= f.date_to)
    if f.date is not None:
        found.append(F.col("captured").startswith(f.date))
    if f.imported is not None:
        found.append(F.col("imported").startswith(f.imported))
    if f.imported_from is not None:
        found.append(F.col("imported") >= f.imported_from)
    if f.has_gps is not None:
        found.append(F.col("lat").isNotNull() if f.has_gps else F.col("lat").isNull())
    if f.named_place is not None:
        found.append(named_place() == f.named_place)
    if f.camera is not None:
        found.append(F.lower("camera") == f.camera.lower())
    if f.lens is not None:
        found.append(F.contains(F.lower("lens"), F.lit(f.lens.lower())))
    if f.library_folder and f.library_folder.strip():
        found += [~F.col("local"), in_folder(F.col("path"), folder_key(f.library_folder), True)]
    if f.merged is not None:
        kind = merged_kind(F.col("file_name"))
        found.append(kind.isNotNull() if f.merged == "any" else kind == f.merged)
    if f.saved_location is not None:
        lat, lon, radius = f.saved_location
        found.append(distance_m(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= radius)
    if f.keyword is not None:
        found.append(has_keyword(f.keyword))
    if f.person is not None:
        found.append(has_person(f.person))
    if f.rule_set is not None:
        found.append(f.rule_set)
    return found + [token_matches(t) for t in f.text.split()]


def apply(photos: DataFrame, f: Filter) -> DataFrame:
    """The photos that a filter lets through. Id sets and albums are semi-joins, so they may be of any size."""
    found = photos.where(reduce(lambda a, b: a & b, conjuncts(f)))
    for ids in (f.only, f.album):
        if ids is not None:
            found = found.join(ids.select("id"), "id", "left_semi")
    return found


def save_preset(presets: dict[str, Filter], name: str, f: Filter) -> dict[str, Filter]:
    """The presets with one more; a name that differs in case only is replaced in its place."""
    name = name.strip()
    if not name or f == Filter():
        raise ValueError("a preset needs a name and a filter that constrains something")
    same = next((n for n in presets if n.lower() == name.lower()), None)
    return {(name if n == same else n): (f if n == same else g) for n, g in presets.items()} | ({} if same else {name: f})


def preset(presets: dict[str, Filter], name: str) -> Filter:
    """A preset by its name in any case; a KeyError without one."""
    return next((f for n, f in presets.items() if n.lower() == name.lower()), None) or presets[name]


def delete_preset(presets: dict[str, Filter], name: str) -> dict[str, Filter]:
    """The presets without one; a KeyError if there is none of that name."""
    preset(presets, name)
    return {n: f for n, f in presets.items() if n.lower() != name.lower()}


def count_presets(photos: DataFrame, presets: dict[str, Filter]) -> DataFrame:
    """(preset, photos): how many photos each preset shows. All without id sets are counted in one pass over the photos."""
    plain = {n: f for n, f in presets.items() if f.only is None and f.album is None}
    shown = [F.count_if(reduce(lambda a, b: a & b, conjuncts(f))).alias(f"n{k}") for k, f in enumerate(plain.values())]
    parts = [apply(photos, f).agg(F.count("*").alias("photos")).select(F.lit(n).alias("preset"), "photos") for n, f in presets.items() if n not in plain]
    if shown:
        named = F.array(*[F.struct(F.lit(n).alias("preset"), F.col(f"n{k}").alias("photos")) for k, n in enumerate(plain)])
        parts.append(photos.agg(*shown).select(F.inline(named)))
    empty = photos.sparkSession.createDataFrame([], "preset string, photos long")
    return reduce(lambda a, b: a.unionByName(b), parts, empty)


def recently_added(photos: DataFrame, days: int = 30) -> DataFrame:
    """What was imported within ``days`` of the latest import."""
    latest = photos.where("not deleted and not local").agg(F.max("imported").alias("latest"))
    since = F.date_sub(F.to_date(F.substring("latest", 1, 10)), days).cast("string")
    return photos.where("not deleted and not local").where(F.substring("imported", 1, 10) >= latest.select(since).scalar())
