"""What other programs say about a library, as filters and rules: criteria of smart collections, entities of a sentence.

Both come as small values that the driver reads; what they select is one pass over the photos."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from math import isfinite

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolith.operators.bulk import COLOURS
from photolith.operators.filters import Filter
from photolith.operators.rules import RuleCompiler

DEEPEST, MOST_RULES = 8, 256
#: How criteria, their tests and their combinations are named there, and here.
COMBINED = {"intersect": "all", "union": "any", "exclude": "none"}
COMPARED = {"==": "is", "!=": "isNot", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}
TEXTS = {name: name for name in ("title", "caption", "creator", "copyright", "camera", "lens", "city", "state", "country", "keywords")} | {"filename": "fileName", "copyname": "copyName"}
FLAGS = {1.0: "pick", -1.0: "reject", 0.0: "none"}
KINDS = {"RAW": "raw", "VIDEO": "video"}
DATES = {"==": "is", ">": "after", "<": "before"}

_TOKEN = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*")|(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|([A-Za-z_]\w*)|([{}=,;\[\]]))')


class Unmapped(ValueError):
    """Criteria without a rule of the same meaning; ``reasons`` names each."""

    def __init__(self, reasons: list[str]) -> None:
        super().__init__("; ".join(reasons))
        self.reasons = reasons


def _table(text: str) -> dict:
    """A table literal, as named values and, under None, a list of the others. Nothing in it is run."""
    body = re.sub(r"^\s*\w+\s*=", "", text, count=1)
    tokens, at = [], 0
    while body[at:].strip():
        match = _TOKEN.match(body, at)
        if not match:
            raise Unmapped([f"unreadable criteria at {at}"])
        tokens.append(match)
        at = match.end()
    found, rest = _value(tokens, 0, 0)
    if rest != len(tokens) or not isinstance(found, dict):
        raise Unmapped(["criteria are not a table"])
    return found


def _value(tokens: list[re.Match], at: int, depth: int) -> tuple[object, int]:
    if at >= len(tokens) or depth > 4 * DEEPEST:
        raise Unmapped(["unreadable criteria"])
    string, number, word, mark = tokens[at].groups()
    if string is not None:
        return re.sub(r"\\(.)", r"\1", string[1:-1]), at + 1
    if number is not None:
        return float(number), at + 1
    if word is not None:
        return {"true": True, "false": False}.get(word), at + 1
    if mark != "{":
        raise Unmapped(["unreadable criteria"])
    found: dict = {None: []}
    at += 1
    while at < len(tokens) and tokens[at][4] != "}":
        key = tokens[at][3] if at + 1 < len(tokens) and tokens[at + 1][4] == "=" else None
        value, at = _value(tokens, at + (2 if key else 0), depth + 1)
        if key:
            found[key] = value
        else:
            found[None].append(value)
        if at < len(tokens) and tokens[at][4] in (",", ";"):
            at += 1
    if at >= len(tokens):
        raise Unmapped(["unreadable criteria"])
    return found, at + 1


def translate(criteria: str) -> dict:
    """A smart collection's criteria as a rule set. All of them or none: one without a rule of the same meaning would change
    which photos are found, so all such are named in ``Unmapped``."""
    reasons: list[str] = []
    counted = [0]
    rules = _group(_table(criteria), 0, counted, reasons)
    if rules is None or reasons or not rules["rules"]:
        raise Unmapped(reasons or ["no criteria"])
    return rules


def _group(table: object, depth: int, counted: list[int], reasons: list[str]) -> dict | None:
    if not isinstance(table, dict) or depth > DEEPEST:
        reasons.append("criteria nested too deeply" if isinstance(table, dict) else "criteria are not a table")
        return None
    mode = COMBINED.get(table.get("combine") or "intersect")
    if mode is None:
        reasons.append(f"combine mode {table['combine']}")
        return None
    rules = []
    for item in table[None]:
        counted[0] += 1
        if counted[0] > MOST_RULES:
            reasons.append("too many criteria")
            return None
        if isinstance(item, dict) and item.get("criteria") is not None:
            rule = _rule(item)
            if rule is None:
                reasons.append(f"criterion {item['criteria']} {item.get('operation', '')}".strip())
            else:
                rules.append(rule)
        elif (inner := _group(item, depth + 1, counted, reasons)) is not None:
            rules.append({"group": inner})
    return {"match": mode, "rules": rules}


def _number(value: object) -> float | None:
    try:
        found = float(value) if isinstance(value, (float, str)) else None
    except ValueError:
        return None
    return found if found is not None and isfinite(found) else None


def _text(value: object) -> str | None:
    if isinstance(value, float):
        return f"{value:g}"
    return value if isinstance(value, str) else None


def _rule(item: Mapping) -> dict | None:
    name, op = item["criteria"], item.get("operation", "")
    one, two = item.get("value"), item.get("value2")
    field, test, value = name, None, None
    if name in ("rating", "iso", "focalLength"):
        numbers = [_number(one), _number(two)]
        test, value = ("between", numbers) if op == "in" else (COMPARED.get(op), numbers[0])
        if value is None or value == [None] or op == "in" and None in numbers:
            return None
    elif name == "pick":
        field, test, value = "flag", {"==": "is", "!=": "isNot"}.get(op), FLAGS.get(_number(one))
    elif name == "labelColor":
        colour = (_text(one) or "").lower()
        field, test, value = "label", {"==": "is", "!=": "isNot"}.get(op), colour if colour in (*COLOURS, "none") else None
    elif name == "fileFormat":
        field, test, value = "kind", {"==": "is", "!=": "isNot"}.get(op), KINDS.get(_text(one))
    elif name == "captureTime":
        dates = [t if (t := _text(v)) and t.strip() else None for v in (one, two)]
        field, test, value = "captureDate", "between" if op == "in" else DATES.get(op), dates if op == "in" else dates[0]
        if op == "in" and None in dates:
            return None
    elif name in TEXTS:
        value = _text(one)
        if not value or not value.strip():
            return None
        single, listed = not re.search(r"\s", value), name == "keywords"
        tests = {"==": "is", "beginsWith": "startsWith"} | ({} if listed else {"!=": "isNot", "endsWith": "endsWith"})
        if single:  # words of a phrase would be looked for one by one
            tests |= {"any": "contains", "all": "contains", "words": "contains", "noneOf": "notContains"}
        field, test = TEXTS[name], tests.get(op)
    return None if test is None or value is None else {"field": field, "op": test, "value": value}


def smart_collections(photos: DataFrame, collections: Mapping[str, str], now: str) -> DataFrame:
    """(collection, photos, unmapped): how many photos of the library each collection holds, counted in one pass, or, without
    a count, why it can't be one here."""
    told: dict[str, dict] = {}
    reasons: dict[str, str] = {}
    for name, criteria in collections.items():
        try:
            told[name] = translate(criteria)
        except Unmapped as e:
            reasons[name] = "; ".join(e.reasons)
    compiler = RuleCompiler(now)
    shown = photos.where("not deleted and not local")
    spark = photos.sparkSession
    parts = [spark.createDataFrame([(n, None, r) for n, r in reasons.items()], "collection string, photos long, unmapped string")]
    if told:
        counts = shown.agg(*[F.count_if(compiler.compile(rules)).alias(f"n{k}") for k, rules in enumerate(told.values())])
        named = [F.struct(F.lit(n).alias("collection"), F.col(f"n{k}").alias("photos"), F.lit(None).cast("string").alias("unmapped")) for k, n in enumerate(told)]
        parts.append(counts.select(F.inline(F.array(*named))))
    return reduce(lambda a, b: a.unionAll(b), parts)


#: Kinds of entities, and what they may say.
ENTITIES = ("keyword", "place", "person", "camera", "lens", "date_from", "date_to", "rating", "rating_comparison", "flag", "color_label", "file_type", "edited")
LEAST_SURE = 0.5
MOST_TOKENS = 6
AT_MOST = ("most", "below", "under", "<", "max", "up to")
EXACTLY = ("exact", "only", "=")
EDITED = {"yes": True, "true": True, "edited": True, "no": False, "false": False, "unedited": False, "not edited": False}
IMAGES = ("image", "jpeg", "jpg", "png", "photo", "heic")


def entities_filter(entities: Iterable[Mapping]) -> Filter:
    """Entities ({"type", "text", "confidence"}) that a model found in a sentence, as a filter of the grid.

    Those it is less than half sure of are passed by, as are unknown kinds and values that no photo can have; of several of
    one kind the first that fits counts, but places and further keywords are looked for as words."""
    found: dict[str, list[str]] = {kind: [] for kind in ENTITIES}
    for e in entities:
        kind, text, sure = str(e.get("type", "")).strip().lower(), e.get("text"), e.get("confidence", 1.0)
        if kind not in found or not isinstance(text, str) or isinstance(sure, bool) or not isinstance(sure, (int, float)) or not isfinite(sure) or sure < LEAST_SURE:
            continue
        text = "".join(c if c.isprintable() else " " for c in text).strip()
        if text and text.lower() not in map(str.lower, found[kind]):
            found[kind].append(text)
    low = {kind: [t.lower() for t in texts] for kind, texts in found.items()}
    first = lambda texts, fit: next((v for t in texts if (v := fit(t)) is not None), None)
    rating = first(found["rating"], lambda t: next((int(c) for c in t if c in "12345"), None)) or 0
    said = low["rating_comparison"][0] if low["rating_comparison"] else ""
    rating_op = "atMost" if any(w in said for w in AT_MOST) else "exactly" if any(w in said for w in EXACTLY) else "atLeast"
    flag = first(low["flag"], lambda t: "none" if t in ("none", "unflagged", "no flag") else "reject" if "reject" in t else "pick" if "pick" in t or "flagged" in t else None)
    kind = first(low["file_type"], lambda t: "raw" if "raw" in t else "video" if "video" in t or "movie" in t else "image" if t in IMAGES else None)
    words = [w for text in (*found["place"], *found["keyword"][1:]) for w in re.split(r"[\s:]+", text) if w][:MOST_TOKENS]
    one = lambda kind: found[kind][0] if found[kind] else None
    return Filter(
        text=" ".join(words), rating=rating, rating_op=rating_op, flag=flag, label=first(low["color_label"], lambda t: next((c for c in COLOURS if c in t), None)), kind=kind,
        edited=first(low["edited"], EDITED.get), keyword=one("keyword"), person=one("person"), camera=one("camera"), lens=one("lens"),
        date_from=first(found["date_from"], _day), date_to=first(found["date_to"], _day),
    )


def _day(text: str) -> str | None:
    """A year, a month or a day between 1800 and 2200."""
    match = re.fullmatch(r"(\d{4})(?:-(\d\d)(?:-(\d\d))?)?", text.strip(), re.A)
    if not match or not 1800 <= int(match[1]) <= 2200 or match[2] and not 1 <= int(match[2]) <= 12:
        return None
    if match[3]:
        year, month = int(match[1]), int(match[2])
        days = 31 - (month in (4, 6, 9, 11)) - (month == 2) * (2 if year % 4 == 0 and (year % 100 != 0 or year % 400 == 0) else 3)
        if not 1 <= int(match[3]) <= days:
            return None
    return match[0]
