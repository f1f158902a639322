"""A corpus pipeline of five stages over ``documents``; each is one of the operators of ``photolith.llm``.

Toxic documents go, then those that the quality rules reject, then all but one of each group of near duplicates; what
is left is mixed to the sources' target weights (documents as often as they are taken), and the mix is encoded and
decoded. ``run`` writes every stage to the shared folder and reads it back for the next, which deletes it once it is done.

Nulls: a null text is empty; it isn't toxic, the quality rules reject it as they do all texts of fewer than 20 words. A
null id or source is one like others. Repeated rows are near duplicates, of which one stays; ties go to the smallest id.
Texts are taken whole, of any length. Empty tables give empty tables. Other columns than those of documents are carried
through the first four stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from photolith.llm import mixing, piece_codec, quality, shingle_join, toxicity
from photolith.llm.common import discard, materialize, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't toxic."""
    small_batches(spark)
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules."""
    small_batches(spark)
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    small_batches(spark)
    return shingle_join.first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of the mix, as digests."""
    import public_tokenizers

    small_batches(spark)
    return piece_codec.digest_rows(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("encode", encode),
]

#: Learned models and a tokenizer's merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
