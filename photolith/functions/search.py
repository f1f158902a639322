"""Ranked text search: stems, terms and scores."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TERMS = 12
#: Words that mean nothing in a search.
STOP = {
    "a", "an", "the", "of", "on", "in", "at", "with", "and", "or", "to", "from", "for", "by", "my", "our", "me", "i",
    "is", "are", "was", "were", "that", "this", "some", "all", "show", "find", "photo", "picture", "shot", "image",
    "pic", "when", "where",
}
#: Words that mean the same in a search.
SYNONYMS = [
    ["dog", "puppy", "pup", "canine", "hound"],
    ["cat", "kitten", "kitty", "feline"],
    ["beach", "shore", "seaside", "coast", "coastline"],
    ["sunset", "dusk", "sundown", "twilight"],
    ["sea", "ocean", "wave", "surf"],
    ["mountain", "peak", "summit", "alp"],
    ["city", "urban", "town"],
    ["forest", "woods", "woodland", "tree"],
    ["flower", "blossom", "bloom"],
    ["child", "kid", "baby", "toddler"],
    ["night", "nighttime", "midnight"],
    ["snow", "winter"],
    ["car", "automobile", "vehicle"],
]

#: Rules by suffix: (what the word must match, characters cut, what is put in their place); the first that fits counts.
_ENDINGS = [
    (r".{2,}ies$", 3, "y"),
    (r"(?=.{5}).*(?:sses|xes|ches|shes)$", 2, ""),
    (r".{2,}[^s]s$", 1, ""),
    (r".{3,}ing$", 3, ""),
    (r".{3,}ed$", 2, ""),
]


def stem(word: str) -> str:
    low = word.lower()
    for pattern, cut, put in _ENDINGS:
        if re.match(pattern, low):
            return low[:-cut] + put
    return low


def stem_column(word: Column) -> Column:
    low = F.lower(word)
    out = low
    for pattern, cut, put in reversed(_ENDINGS):
        out = F.when(low.rlike("^" + pattern), F.concat(F.left(low, F.length(low) - cut), F.lit(put))).otherwise(out)
    return out


def terms(query: str) -> list[tuple[list[str], str | None]]:
    """(accepted stems, year) of each word that counts, of the first twelve."""
    found = []
    for word in [w for w in re.split(r"[\W_]+", query) if w][:MAX_TERMS]:
        low = word.lower()
        if re.fullmatch(r"[0-9]{4}", low):
            found.append(([], low))
        elif low not in STOP and stem(low) not in STOP:
            own = stem(low)
            group = next((g for g in SYNONYMS if own in map(stem, g)), [low])
            found.append((sorted({stem(g) for g in group}), None))
    return found


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def words_with_stem(own: str) -> list[str]:
    """All words whose stem is ``own``: the endings' rules turned round."""
    made = [own] + [own[: len(own) - len(put)] + end for end, put in (("ies", "y"), ("es", ""), ("s", ""), ("ing", ""), ("ed", "")) if own.endswith(put)]
    return [w for w in made if stem(w) == own]


def has_stem(text: Column, accepted: list[str]) -> Column:
    """Whether a word of the text has one of the stems: one pass of a pattern over the text, no words are made."""
    every = sorted({w for s in accepted for w in words_with_stem(s)})
    case = "(?i)" if all(map(str.isascii, every)) else "(?iu)"
    starts = "".join(sorted({re.escape(w[0]) for w in every}))  # looked at first, as most places in a text fail there
    return text.rlike(rf"{case}(?=[{starts}])(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(re.escape, every))})(?![\p{{L}}\p{{N}}])")


def score(weighted: list[tuple[int, Column]], captured: Column, query: str) -> Column:
    """Per term the best weight of a text (3, 2, 1) with an accepted word, a year counts 2; summed."""
    total = F.lit(0)
    for accepted, year in terms(query):
        if year:
            best = F.when(captured.startswith(year), 2).otherwise(0)
        else:
            best = F.lit(0)
            for weight, text in sorted(weighted, key=lambda x: x[0]):
                best = F.when(has_stem(text, accepted), weight).otherwise(best)
        total = total + best
    return total
