"""Smart-album rules: nested groups of typed field tests, checked and compiled to one boolean column.

Every leaf is two-valued (a missing operand has a defined answer), so that negation and ``none`` groups mean what they
say. A rule set is a dict: {"match": "all" | "any" | "none", "rules": [rule, ...]}, a rule {"field", "op", "value"} or a
nested set under "group".
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Mapping
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photolith.functions.names import keyword_count, people

TEXT_OPS = ("contains", "notContains", "is", "isNot", "startsWith", "endsWith", "isEmpty", "isNotEmpty")
NAME_OPS = ("contains", "notContains", "is", "startsWith", "isEmpty", "isNotEmpty")
NUMBER_OPS = ("is", "isNot", "gte", "lte", "gt", "lt", "between")
DATE_OPS = ("is", "after", "before", "between", "inLast", "notInLast", "isEmpty")
OPS = {"text": TEXT_OPS, "path": TEXT_OPS, "names": NAME_OPS, "number": NUMBER_OPS, "date": DATE_OPS, "choice": ("is", "isNot"), "album": ("is", "isNot"), "bool": ("is",)}
DEEPEST = 32
UNITS = {"hour": 3600.0, "day": 86400.0, "week": 7 * 86400.0, "month": 30.4375 * 86400, "year": 365.25 * 86400}
LONGEST = 10_000 * 365.25 * 86400


def shown_size() -> tuple[Column, Column]:
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    return F.when(F.col("swapped"), h).otherwise(w), F.when(F.col("swapped"), w).otherwise(h)


def aspect() -> Column:
    w, h = shown_size()
    near = F.abs(w - h) <= 0.01 * F.greatest(w, h)
    return F.when((w > 0) & (h > 0), F.when(near, "square").when(w > h, "landscape").otherwise("portrait"))


def shutter_seconds(text: Column) -> Column:
    """``1/250``, ``2"`` or ``30s`` in seconds; null if it isn't a time."""
    plain = F.regexp_replace(F.trim(text), r'("|s)$', "")
    parts = F.split(plain, "/")
    whole, under = parts[0].try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    secs = F.when(F.size(parts) == 1, whole).when((F.size(parts) == 2) & (under > 0), F.try_divide(whole, under))
    return F.when((secs > 0) & (secs < 1e300), secs)


def _join(*columns: str | Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns])


def _everything() -> Column:
    return _join(
        "file_name", "title", "caption", "camera", "lens", "location", "city", "state", "country", "alt_text", "format",
        F.array_join("keywords", " "), F.array_join(people(F.col("names")), " "), "copy_name",
    )


def _edge(pick: Callable) -> Callable[[], Column]:
    return lambda: F.round(pick(*shown_size()))


#: field -> (kind, operand)
FIELDS: dict[str, tuple[str, Callable[[], Column]]] = {
    name: (kind, operand if callable(operand) else (lambda c=operand: F.col(c)))
    for name, kind, operand in (
        ("rating", "number", "rating"), ("flag", "choice", "flag"), ("label", "choice", lambda: F.coalesce("label", F.lit("none"))),
        ("text", "text", _everything), ("album", "album", "id"), ("virtualCopy", "bool", lambda: F.col("copy_of").isNotNull()),
        ("copyName", "text", "copy_name"), ("stacked", "bool", lambda: F.col("stack_id").isNotNull()), ("fileName", "text", "file_name"),
        ("extension", "text", lambda: F.regexp_extract("file_name", r"^.+\.([^.]*)$", 1)),
        ("filePath", "path", lambda: F.replace("path", F.lit("\\"), F.lit("/"))), ("kind", "choice", "kind"), ("format", "text", "format"),
        ("duration", "number", "duration"), ("captureDate", "date", "captured"), ("importDate", "date", "imported"), ("editDate", "date", "edited"),
        ("keywords", "names", "keywords"), ("keywordCount", "number", lambda: keyword_count(F.col("keywords"))),
        ("person", "names", lambda: people(F.col("names"))), ("personCount", "number", lambda: F.size(people(F.col("names")))),
        ("title", "text", "title"), ("caption", "text", "caption"), ("altText", "text", "alt_text"), ("creator", "text", "creator"),
        ("copyright", "text", "copyright"), ("copyrightStatus", "choice", "copyright_status"), ("camera", "text", "camera"), ("lens", "text", "lens"),
        ("focalLength", "number", "focal"), ("aperture", "number", "aperture"), ("shutterSpeed", "number", lambda: shutter_seconds(F.col("shutter"))),
        ("iso", "number", "iso"), ("location", "text", lambda: _join("location", "city", "state", "country")), ("city", "text", "city"),
        ("state", "text", "state"), ("country", "text", "country"), ("hasGps", "bool", lambda: F.col("lat").isNotNull()),
        ("longEdge", "number", _edge(F.greatest)), ("shortEdge", "number", _edge(F.least)), ("aspect", "choice", aspect),
        ("megapixels", "number", lambda: shown_size()[0] * shown_size()[1] / 1e6), ("edited", "bool", "is_edited"), ("cropped", "bool", "is_cropped"),
        ("treatment", "choice", "treatment"), ("sharpness", "number", "sharpness"),
        ("bestOfGroup", "bool", lambda: F.col("sharpness").isNotNull() & (F.col("best") | F.col("burst").isNull())),
    )
}

_CHOICES = {"flag": {"picked": "pick", "rejected": "reject"}}


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def text_test(op: str, have: Column, want: str) -> Column:
    have = F.lower(F.trim(F.coalesce(have, F.lit(""))))
    words = [F.contains(have, F.lit(w)) for w in want.split()]
    return {
        "contains": lambda: reduce(lambda a, b: a & b, words, F.lit(True)),
        "notContains": lambda: ~reduce(lambda a, b: a | b, words, F.lit(False)),
        "is": lambda: have == want,
        "isNot": lambda: have != want,
        "startsWith": lambda: have.startswith(want),
        "endsWith": lambda: have.endswith(want),
        "isEmpty": lambda: have == "",
        "isNotEmpty": lambda: have != "",
    }[op]()


def path_test(op: str, have: Column, want: str) -> Column:
    """Like text, but ``contains`` takes its whole operand, and an empty one is in no path."""
    want = want.replace("\\", "/")
    if op not in ("contains", "notContains"):
        return text_test(op, have, want)
    inside = _sure(F.contains(F.lower(have), F.lit(want.strip()))) if want.strip() else F.lit(False)
    return inside if op == "contains" else ~inside


def names_test(op: str, names: Column, want: str) -> Column:
    some = lambda test: _sure(F.exists(F.coalesce(names, F.array().cast("array<string>")), test))
    if op in ("isEmpty", "isNotEmpty"):
        filled = some(lambda n: F.trim(n) != "")
        return filled if op == "isNotEmpty" else ~filled
    if op == "notContains":
        return ~some(lambda n: text_test("contains", n, want))
    level = lambda n: F.exists(F.split(F.lower(n), r"\|"), lambda part: F.trim(part) == want)
    return some(lambda n: text_test(op, n, want) | (level(n) if op == "is" else F.lit(False)))


def number(value) -> float | None:
    """A number, or one as typed: ``f/2.8``, ``50mm``."""
    if isinstance(value, bool) or value is None:
        return None
    try:
        return float(re.sub(r"^(f/)+|(mm)+$", "", value.strip()).strip() if isinstance(value, str) else value)
    except (TypeError, ValueError):
        return None


def number_test(op: str, have: Column, value, read: Callable = number) -> Column:
    """Equality has a tolerance of 1e-6, bounds one of 1e-9; a missing number only ``isNot`` something."""
    have = have.cast("double")
    known = have.isNotNull() & ~F.isnan(have)
    if op == "between":
        ends = [read(v) for v in value] if isinstance(value, (list, tuple)) and len(value) == 2 else [None]
        return F.lit(False) if None in ends else _sure(known & have.between(min(ends), max(ends)))
    want = read(value)
    if want is None:
        return have.isNull() if op == "isNot" else F.lit(False)
    tests = {
        "is": lambda: F.abs(have - want) < 1e-6, "isNot": lambda: F.abs(have - want) >= 1e-6, "gte": lambda: have >= want - 1e-9,
        "lte": lambda: have <= want + 1e-9, "gt": lambda: have > want, "lt": lambda: have < want,
    }
    test = _sure(known & tests[op]())
    return have.isNull() | test if op == "isNot" else test


def _seconds(value) -> float | None:
    if isinstance(value, str) and (match := re.fullmatch(r'\s*([\d.]+)\s*(?:/\s*([\d.]+))?\s*(?:"|s)?\s*', value)):
        under = float(match[2] or 1)
        value = float(match[1]) / under if under else None
    found = number(value)
    return found if found and found > 0 else None


def span_seconds(value) -> float | None:
    """Of {"n": 3, "unit": "weeks"} or a number of days; None if it is no positive span."""
    n, unit = (value.get("n"), value.get("unit")) if isinstance(value, Mapping) else (value, None)
    per = UNITS.get(str(unit or "day").strip().lower().removesuffix("s"))
    n = number(n)
    return min(n * per, LONGEST) if n and per and n > 0 else None


def _date(value) -> str:
    return re.sub(r"^(\d{4}-\d\d-\d\d) ", r"\1T", str(value).strip()) if value is not None else ""


def date_test(op: str, have: Column, value, now: str) -> Column:
    """ISO texts, compared as texts; a date is also a prefix of times on it."""
    missing = have.isNull() | (have == "")
    if op == "isEmpty":
        return missing
    if op in ("inLast", "notInLast"):
        secs = span_seconds(value)
        if secs is None:
            return missing if op == "notInLast" else F.lit(False)
        try:
            since = (datetime.fromisoformat(now) - timedelta(seconds=int(secs))).isoformat()
            inside = have >= since
        except OverflowError:
            inside = F.lit(True)
        return ~missing & inside if op == "inLast" else missing | ~inside
    if op == "between":
        a, b = (_date(v) for v in value)
        test = (have >= a) & ((have <= b) | have.startswith(b))
    else:
        w = _date(value)
        if not w:
            return F.lit(False)
        test = {"is": have.startswith(w), "after": (have > w) & ~have.startswith(w), "before": have < w}[op]
    return _sure(~missing & test)


class RuleCompiler:
    """Compiles rule sets over a photo table. ``albums``: id -> its rule set (smart) or an array-free membership column.

    Rules that name smart albums are compiled by ``over``, which gives each album that is named more than once a column of
    its own, worked out once per photo in the order in which the albums need each other."""

    def __init__(self, now: str, albums: Mapping[int, dict | Column] | None = None, label_names: Mapping[str, str] | None = None) -> None:
        self.now, self.albums, self.label_names = now, albums or {}, label_names or {}
        self.open: list[int] = []
        self.columns: dict[int, Column] = {}
        self.cuts: set[tuple[int | None, int]] | None = None

    def over(self, photos: DataFrame, rules: dict) -> tuple[DataFrame, Column]:
        """The photos with the columns that the rules' test needs, and that test.

        A reference to an album that is being worked out (a loop), or beyond ``DEEPEST`` albums, holds nothing, as it is met
        in the order of the rules from the outermost on; an album worked out once is known from then on."""
        order, self.cuts, uses = self._order(rules)
        turn: dict[int, int] = {}
        for album in order:
            needs = [other for other in referred(self.albums[album]) if (album, other) not in self.cuts and other in turn]
            turn[album] = max((turn[other] + (uses[other] > 1) for other in needs), default=0)
        shared = [album for album in order if uses[album] > 1]
        for k in sorted({turn[album] for album in shared}):
            tests = {album: self._body(album) for album in shared if turn[album] == k}
            # as a generator's output the columns are worked out once; a projection's would be put in place of their names
            photos = photos.select("*", F.inline(F.array(F.struct(*[test.alias(f"_album_{album}") for album, test in tests.items()]))))
            self.columns |= {album: F.col(f"_album_{album}") for album in tests}
        return photos, self.compile(rules)

    def _order(self, rules: dict) -> tuple[list[int], set[tuple[int | None, int]], Counter]:
        """Smart albums, each after those it needs; references that are cut, as (from, to); how often each is named."""
        order, cuts, uses = [], set(), Counter()

        def visit(rules: dict, at: int | None, stack: tuple[int, ...]) -> None:
            for other in referred(rules):
                if not isinstance(self.albums.get(other), Mapping):
                    continue
                if other not in order and (other in stack or len(stack) >= DEEPEST):
                    cuts.add((at, other))
                    continue
                uses[other] += 1
                if other not in order:
                    visit(self.albums[other], other, (*stack, other))
                    order.append(other)

        visit(rules, None, ())
        return order, cuts, uses

    def _body(self, album_id: int) -> Column:
        self.open.append(album_id)
        found = self.compile(self.albums[album_id]) & ~F.col("deleted")
        self.open.pop()
        return found

    def compile(self, rules: dict) -> Column:
        tests = [self.compile(r["group"]) if "group" in r else self.leaf(r["field"], r["op"], r.get("value")) for r in rules.get("rules", [])]
        match = rules.get("match", "all")
        if not tests:
            return F.lit(match != "any")
        if match == "all":
            return reduce(lambda a, b: a & b, tests)
        some = reduce(lambda a, b: a | b, tests)
        return some if match == "any" else ~some

    def leaf(self, field: str, op: str, value) -> Column:
        kind, operand = FIELDS[field]
        want = "" if value is None else str(value).strip().lower()
        if field == "extension":
            want = want.lstrip(".")
        if kind == "album":
            found = self.album(value)
            return found if op == "is" else ~found
        have = operand()
        if kind == "bool":
            return _sure(have == value) if isinstance(value, bool) else F.lit(False)
        if kind == "choice":
            accepted = {_CHOICES.get(field, {}).get(want, want)}
            if field == "label":
                accepted |= {colour for colour, name in self.label_names.items() if name.lower() == want}
            found = _sure(F.lower(have).isin(*sorted(accepted)))
            return found if op == "is" else ~found
        if kind == "number":
            return number_test(op, have, value, _seconds if field == "shutterSpeed" else number)
        if kind == "date":
            return date_test(op, have, value, self.now)
        return {"text": text_test, "path": path_test, "names": names_test}[kind](op, have, want)

    def album(self, album_id) -> Column:
        """Photos of an album: a smart one's column, or its rules in its place."""
        album = self.albums.get(album_id)
        if album is None:
            return F.lit(False)
        if isinstance(album, Column):
            return _sure(album)
        if self.cuts is None:  # compiled alone, without a table to put columns into
            cut = album_id in self.open or len(self.open) >= DEEPEST
        else:
            cut = (self.open[-1] if self.open else None, album_id) in self.cuts
        if cut:
            return F.lit(False)
        return self.columns.get(album_id) if album_id in self.columns else self._body(album_id)


def select(photos: DataFrame, rules: dict, now: str, albums: Mapping | None = None) -> DataFrame:
    """A smart album's photos: those in the library that the rules let through."""
    found, test = RuleCompiler(now, albums).over(photos, rules)
    return found.where(test & ~F.col("deleted") & ~F.col("local")).select(*photos.columns)


def referred(rules: dict | Column) -> list[int]:
    """The albums that a rule set names, in the order of the rules."""
    out = []
    for r in rules.get("rules", []) if isinstance(rules, Mapping) else []:
        out += referred(r["group"]) if "group" in r else [r["value"]] if r["field"] == "album" else []
    return out


def issues(rules: dict, path: str = "rules", depth: int = 0, label_names: Iterable[str] = ()) -> list[tuple[str, str]]:
    """(where, what) is wrong with a rule set; empty if it can be compiled. ``label_names``: names given to colours."""
    found = [] if rules.get("match", "all") in ("all", "any", "none") else [(path, "unknown match")]
    if depth > DEEPEST:
        return [(path, "too deep")]
    for k, rule in enumerate(rules.get("rules", [])):
        at = f"{path}[{k}]"
        if "group" in rule:
            found += issues(rule["group"], f"{at}.group", depth + 1, label_names)
        elif (field := rule.get("field")) not in FIELDS:
            found.append((at, "unknown field"))
        elif rule.get("op") not in OPS[FIELDS[field][0]]:
            found.append((at, "unknown operator"))
        else:
            found += [(at, what) for what in _value_issue(FIELDS[field][0], rule["op"], rule.get("value"), field, label_names)]
    return found


def _value_issue(kind: str, op: str, value, field: str, label_names: Iterable[str] = ()) -> list[str]:
    if op in ("isEmpty", "isNotEmpty"):
        return []
    if kind == "choice" and field in CHOICES:
        known = {c.lower() for c in CHOICES[field]} | set(_CHOICES.get(field, {})) | ({n.lower() for n in label_names} if field == "label" else set())
        return [] if isinstance(value, str) and value.strip().lower() in known else [f"one of {', '.join(CHOICES[field])} needed"]
    if op == "between" and not (isinstance(value, (list, tuple)) and len(value) == 2):
        return ["two values needed"]
    values = value if op == "between" else [value]
    if kind == "number" and any((_seconds if field == "shutterSpeed" else number)(v) is None for v in values):
        return ["not a number"]
    if kind == "bool" and not isinstance(value, bool):
        return ["not true or false"]
    if op in ("inLast", "notInLast"):
        return [] if span_seconds(value) else ["not a span"]
    if kind == "date" and not all(valid_date(_date(v)) for v in values):
        return ["not a date"]
    if kind == "date" and op == "between" and _date(values[0]) > _date(values[1]) and not _date(values[0]).startswith(_date(values[1])):
        return ["the first date is after the second"]
    if kind in ("text", "names", "path") and not isinstance(value, str):
        return ["not a text"]
    return []


def valid_date(text: str) -> bool:
    """A year, a month, a day or a time of a real calendar day, with a zone or a fraction at will."""
    match = re.fullmatch(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:T(\d\d):(\d\d)(?::(\d\d)(?:\.\d+)?)?(?:Z|[+-]\d\d:\d\d)?)?)?)?", text)
    if not match:
        return False
    y, mo, d, h, mi, s = (int(x) if x else None for x in match.groups())
    try:
        datetime(y or 1, mo or 1, d or 1, h or 0, mi or 0, s or 0)
    except ValueError:
        return False
    return True


#: How fields and tests are called in a sentence, where their names don't say it, and what choices there are.
LABELS = {
    "flag": "pick flag", "label": "color label", "text": "any searchable text", "stacked": "in a stack", "fileName": "filename", "extension": "file extension", "kind": "file type", "format": "file format",
    "duration": "video duration", "person": "people", "personCount": "people count", "iso": "iso speed", "state": "state / province", "hasGps": "has gps", "aspect": "aspect ratio", "edited": "has edits",
    "sharpness": "focus (assisted culling)", "bestOfGroup": "best of similar shots",
}
OP_LABELS = {
    "notContains": "doesn't contain", "isNot": "isn't", "startsWith": "starts with", "endsWith": "ends with", "isEmpty": "is empty", "isNotEmpty": "isn't empty", "gte": "is ≥", "lte": "is ≤", "gt": "is >",
    "lt": "is <", "between": "is between", "after": "is after", "before": "is before", "inLast": "is in the last", "notInLast": "isn't in the last",
}
CHOICES = {
    "flag": {"pick": "picked", "reject": "rejected", "none": "unflagged"}, "label": {c: c for c in ("red", "yellow", "green", "blue", "purple")} | {"none": "no label"},
    "kind": {"image": "image", "raw": "raw", "video": "video"}, "copyrightStatus": {"copyrighted": "copyrighted", "publicDomain": "public domain", "unknown": "unknown"},
    "aspect": {"landscape": "landscape (wide)", "portrait": "portrait (tall)", "square": "square"}, "treatment": {"color": "in color", "monochrome": "black & white"},
}


def field_label(field: str) -> str:
    """``longEdge`` as long edge."""
    return LABELS.get(field, re.sub(r"(?=[A-Z])", " ", field).lower())


def describe(rules: dict, album_names: Mapping[int, str] | None = None) -> str:
    """A rule set in words; albums by their names, or by their numbers where those are unknown."""

    def value_of(field: str, value) -> str:
        if field == "album":
            return f"“{album_names[value]}”" if album_names and value in album_names else f"#{value}"
        if isinstance(value, bool):
            return "yes" if value else "no"
        if isinstance(value, str):
            return CHOICES.get(field, {}).get(value, value)
        if isinstance(value, Mapping):
            return f"{value.get('n', '')} {value.get('unit') or 'days'}"
        if isinstance(value, (list, tuple)):
            return " – ".join(map(str, value))
        return "" if value is None else str(value)

    def op_of(field: str, op: str) -> str:
        if FIELDS.get(field, ("",))[0] == "names" and op in ("isEmpty", "isNotEmpty"):
            return "are empty" if op == "isEmpty" else "aren't empty"
        return OP_LABELS.get(op, op)

    parts = [
        f"({describe(r['group'], album_names)})" if "group" in r else f"{field_label(r['field'])} {op_of(r['field'], r['op'])} {value_of(r['field'], r.get('value'))}".strip()
        for r in rules.get("rules", [])
    ]
    text = {"all": " and ", "any": " or ", "none": " nor "}[rules.get("match", "all")].join(parts)
    return f"none of: {text}" if rules.get("match") == "none" else text


def upgrade(rules: dict) -> dict:
    """Rules of an earlier form: album tests named notIn become isNot, and in becomes is."""
    names = {"notIn": "isNot", "in": "is"}
    return {
        "match": rules.get("match", "all"),
        "rules": [
            {"group": upgrade(r["group"])} if "group" in r else {**r, "op": names.get(r["op"], r["op"])} if r.get("field") == "album" else r
            for r in rules.get("rules", [])
        ],
    }


def reaches(albums: Mapping[int, dict], start: int, goal: int) -> bool:
    """Whether an album's rules lead, through others, to ``goal``."""
    seen, waiting = set(), [start]
    while waiting:
        at = waiting.pop()
        for other in referred(albums.get(at, {})):
            if other == goal:
                return True
            if other not in seen:
                seen.add(other)
                waiting.append(other)
    return False
