"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies.

A pre-token here is a run of non-space characters with the one space before it, or a run of white space: the byte-level
pattern never joins characters across these, so the pieces of a text are the pieces of its pre-tokens. The library's
special string is cut out first and counts as one token, as in the library. No ids of a document are ever built.

1. Distinct pre-tokens of the corpus are counted (tasks add up first).
2. The library counts the pieces of each, once; the table goes to the shared folder.
3. Documents sum the pieces of frequent pre-tokens from a broadcast of bounded size; their other pre-tokens become
   rows (document, pre-token, frequency), which are joined to the table and summed per document.

A document is known by its id and the crc32 of its text; rows that share both are counted together and given back as
often as they came. Nulls: a null text counts as empty (0 tokens); a null id stays null. Empty tables give no rows.
Columns besides doc_id and text are ignored, whatever their names. Texts are taken whole, of any length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith.llm.common import materialize, table
from photolith.llm.vocabulary import count_strings, most_frequent

LIMIT = 1024
#: Fixed value: characters with the Unicode property White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PRE_TOKEN = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def pre_tokens(text: str, special: str) -> Iterator[str]:
    for part in text.split(special) if special in text else (text,):
        yield from _PRE_TOKEN.findall(part)


def special_string(tokenizer_path: str) -> str:
    """The one added special token that the library finds in texts."""
    from tokenizers import Tokenizer

    added = Tokenizer.from_file(tokenizer_path).get_added_tokens_decoder()
    (only,) = [t.content for t in added.values()]
    return only


def count_tokens(docs: DataFrame, tokenizer_path: str, special: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, n_tokens) for the byte-level tokenizer whose file each worker has at ``tokenizer_path``."""
    spark = docs.sparkSession

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread keeps memory of its own
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                counted = [len(e) for e in tokenizer.encode_batch_fast(part.column(0).to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counted, pa.int64())], ["piece", "n", "pieces"])

    counts = count_strings(docs, "text", lambda text: pre_tokens(text, special), "string")
    counts = materialize(counts.mapInArrow(pieces, "piece string, n long, pieces long"), "pre-tokens")
    known = spark.sparkContext.broadcast(most_frequent(counts, ["piece", "pieces"]))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = dict(zip(known.value.column(0).to_pylist(), known.value.column(1).to_pylist(), strict=True))
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                raw = text.encode()
                crc, total = zlib.crc32(raw), text.count(special)
                rare: Counter = Counter()
                for piece in pre_tokens(text, special):
                    if (n := frequent.get(piece)) is not None:
                        total += n
                    else:
                        rare[piece] += 1
                # the document's own row has a key that no pre-token has, so that these rows spread evenly
                for piece, n, known_sum, size in [(f"  {doc_id} {crc} .", 0, total, len(raw)), *((p, n, 0, None) for p, n in rare.items())]:
                    for to, value in zip(rows, (doc_id, crc, piece, n, known_sum, size), strict=True):
                        to.append(value)
                if len(rows[0]) > 10_000:
                    yield _batch(rows)
                    rows = ([], [], [], [], [], [])
            if rows[0]:
                yield _batch(rows)

    parts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        frequencies, "doc_id long, crc long, piece string, freq long, known long, n_bytes long"
    )
    summed = (
        parts.join(counts.select("piece", "pieces"), "piece", "left")
        .groupBy("doc_id", "crc")
        .agg(
            F.count("n_bytes").alias("copies"),
            F.max("n_bytes").alias("n_bytes"),
            F.sum(F.col("known") + F.col("freq") * F.coalesce("pieces", F.lit(0))).alias("all_tokens"),
        )
    )
    return summed.select(
        "doc_id", "n_bytes", (F.col("all_tokens") / F.col("copies")).cast("long").alias("n_tokens"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    ).drop("_copy")


def _batch(rows: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["doc_id", "crc", "piece", "freq", "known", "n_bytes"]
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = count_tokens(table(spark, sf_dir, "documents"), path, special_string(path))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
