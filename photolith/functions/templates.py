"""File names from templates: ``{tag}`` and ``%`` date directives compile to one expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEM = r"\.[^.]*$"
TAGS = {
    "name": lambda: F.regexp_replace("file_name", _STEM, ""),
    "ext": lambda: F.lower(F.regexp_extract("file_name", r"^.+\.([^.]*)$", 1)),
    "year": lambda: F.substring("captured", 1, 4),
    "month": lambda: F.substring("captured", 6, 2),
    "day": lambda: F.substring("captured", 9, 2),
    "hour": lambda: F.substring("captured", 12, 2),
    "minute": lambda: F.substring("captured", 15, 2),
    "second": lambda: F.substring("captured", 18, 2),
    "rating": lambda: F.col("rating").cast("string"),
    "camera": lambda: F.col("camera"),
    "lens": lambda: F.col("lens"),
    "iso": lambda: F.col("iso").cast("string"),
    "title": lambda: F.col("title"),
    "city": lambda: F.col("city"),
    "seq": lambda: F.col("seq").cast("string"),
}
_DIRECTIVES = {"%Y": "year", "%m": "month", "%d": "day", "%H": "hour", "%M": "minute", "%S": "second"}


def expand(template: str) -> Column:
    """Unknown tags stay as they are; a missing value is empty."""
    parts = []
    for piece in re.split(r"(\{\w+\}|%[YmdHMS])", template):
        tag = _DIRECTIVES.get(piece, piece.strip("{}") if piece.startswith("{") else "")
        parts.append(F.coalesce(TAGS[tag](), F.lit("")) if tag in TAGS else F.lit(piece))
    return F.concat(*parts)


def sanitize(name: Column) -> Column:
    """Characters that some file systems forbid become dashes."""
    return F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]', "-")


def folder_parts(template: str) -> Column:
    return F.filter(F.transform(F.split(expand(template), "/"), lambda p: F.trim(sanitize(p))), lambda p: p != "")
