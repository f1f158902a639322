"""Metadata of files: sidecars, precedence of sources, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDECAR = "title string, caption string, rating int, label string, creator string, city string, country string, subject struct<Bag: struct<li: array<string>>>"


def parse_sidecar(text: Column) -> Column:
    """The simple properties of an XMP packet, without its name spaces -> struct."""
    body = F.regexp_extract(text, r"(?s)<rdf:Description[^>]*>(.*)</rdf:Description>", 1)
    plain = F.regexp_replace(F.regexp_replace(body, r"<(/?)\w+:(\w+)[^>]*>", "<$1$2>"), r"</?Alt>|<li xml:lang[^>]*>", "")
    low = F.regexp_replace(F.regexp_replace(plain, "<(/?)Rating>", "<$1rating>"), "<(/?)Label>", "<$1label>")
    return F.from_xml(F.concat(F.lit("<d>"), low, F.lit("</d>")), SIDECAR)


def write_sidecar(title: Column, rating: Column, label: Column, keywords: Column) -> Column:
    """An XMP packet with these properties; missing ones are left out."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), safe(c.cast("string")), F.lit(f"</{name}>")), F.lit(""))
    items = F.array_join(F.transform(keywords, lambda k: F.concat(F.lit("<rdf:li>"), safe(k), F.lit("</rdf:li>"))), "")
    bag = F.concat(F.lit("<dc:subject><rdf:Bag>"), items, F.lit("</rdf:Bag></dc:subject>"))
    return F.concat(
        F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF><rdf:Description rdf:about="">'), tag("dc:title", title), tag("xmp:Rating", rating),
        tag("xmp:Label", label), bag, F.lit("</rdf:Description></rdf:RDF></x:xmpmeta>"),
    )


def fill_missing(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Our fields, and theirs where ours are null."""
    both = ours.alias("a").join(theirs.alias("b"), key, "left")
    return both.select(key, *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) if c in theirs.columns else F.col(f"a.{c}").alias(c) for c in ours.columns if c != key])


def merge_properties(old: Column, new: Column, owned: list[str]) -> Column:
    """Maps: foreign properties stay, those in ``owned`` are replaced by the new ones or go."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~k.isin(*owned)), F.map_filter(new, lambda k, _: k.isin(*owned)))
