"""WARC archives: written by Spark's text writer, read by a Python data source.

Writing: a record per row, payload in UTF-8. Of records with equal payloads of at least 1000 bytes the one with the
largest id is a response and the others revisit it; smaller ones are responses. Only ids, lengths and digests are
shuffled to find that out, with a sum per digest before the shuffle; records are built and compressed where the payload
is. The files are gzip'd WARC/1.1, committed by Spark's own writer, in the shared folder.

Reading: ``spark.read.format("warc")`` plans one partition per file from the list that the driver hands it (Spark lists
them, on whatever store), takes predicates on record_type and on header columns, parses headers first, and skips the
bytes of a payload unless the record passes; with payload=digest it hands on length and digest only.

Nulls: a null payload counts as empty; a null url is written as an empty header; a record without an id is a response, as
none is known to come after it. Rows with equal ids and payloads each get a record: of several with the largest id, all are
responses. Empty tables give an archive without records. Columns besides page_id, url and html are ignored, whatever their
names. Payloads are taken whole, of any length.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import operator
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
    LessThanOrEqual, StringContains, StringStartsWith,
)

from photolith.llm.common import shared_dir, table

REVISIT_FROM = 1000
#: Named fields and profile of the WARC/1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: All records carry one date, so that archives of equal rows are equal.
DATE = "2024-01-01T00:00:00Z"
SCHEMA = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"
)


def with_roles(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> with payload, payload_bytes, payload_digest, refers_to (null for responses).

    The first page of each repeated payload comes from a sum by digest (one row per digest and task is shuffled) and
    meets the rows again in a join on the digest, spread over salts, so that no task holds a whole group of copies.
    """
    salts = 16
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    page = page.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    copies = page.where(F.col("payload_bytes") >= REVISIT_FROM).groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
    roles = (
        page.where(F.col("payload_bytes") >= REVISIT_FROM)
        .select("page_id", "payload_digest", F.pmod(F.hash("page_id"), F.lit(salts)).alias("_salt"))
        .join(copies.where("_n > 1").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["payload_digest", "_salt"])
        .where(F.col("page_id") < F.col("_first"))
        .select("page_id", "payload_digest", F.col("_first").alias("refers_to"))
        .distinct()
    )
    same = F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.payload_digest") == F.col("r.payload_digest"))
    return page.alias("p").join(roles.alias("r"), same, "left").select("p.*", "r.refers_to")


def record_text(row: DataFrame) -> DataFrame:
    """One WARC record per row as text, without its last line feed, which the text writer adds."""
    revisit = F.col("refers_to").isNotNull()
    record_id = lambda c: F.concat(F.lit("<urn:photolith:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id("page_id")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id("refers_to")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    return row.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload")), F.lit("\r\n\r")).alias("value"))


def write_warc(pages: DataFrame, path: str) -> None:
    """Writes .warc.gz files (Spark names them .txt.gz) to ``path``."""
    record_text(with_roles(pages)).write.option("compression", "gzip").option("lineSep", "\n").text(path)


_OPS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_OPS |= {In: lambda x, y: x in y, StringContains: lambda x, y: y in x, StringStartsWith: str.startswith}
_HEADER_COLUMNS = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to")


class WarcFile(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class WarcReader(DataSourceReader):
    """Options: files, a JSON list of paths; payload: full (default), digest (verify and drop), none (skip)."""

    def __init__(self, options) -> None:
        self.files = json.loads(options.get("files", "[]"))
        self.payload = options.get("payload", "full")
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _OPS and len(f.attribute) == 1 and f.attribute[0] in _HEADER_COLUMNS:
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [WarcFile(p) for p in self.files]

    def passes(self, row: dict) -> bool:
        return all(row[c] is not None and _OPS[kind](row[c], value) for c, kind, value in self.tests)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open_stream(partition.path) as raw, gzip.open(raw) as file:
            for row, length, stream in records(file):
                if not self.passes(row):
                    skip(stream, length)
                    continue
                payload = None
                if self.payload == "none" or row["record_type"] == "revisit":
                    skip(stream, length)
                elif self.payload == "digest":
                    row["payload_bytes"], row["payload_digest"] = digest(stream, length)
                else:
                    body = stream.read(length)
                    row["payload_bytes"], row["payload_digest"] = len(body), hashlib.sha1(body).hexdigest()
                    payload = body.decode()
                yield (*(row[c] for c in _HEADER_COLUMNS), payload)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)


def open_stream(path: str):
    """A readable stream: plain paths and file: ones directly, others through Arrow's file systems."""
    if path.startswith("file:"):
        path = re.sub(r"^file:/+", "/", path)
    if path.startswith("/"):
        return open(path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_stream(inner)


def records(file: io.BufferedIOBase) -> Iterator[tuple[dict, int, io.BufferedIOBase]]:
    """Headers of each record and the length of its block, which the caller reads or skips."""
    while version := file.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        head = {}
        while (line := file.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        refers = head.get("warc-refers-to")
        yield (
            {
                "page_id": _page(head["warc-record-id"]),
                "url": head.get("warc-target-uri"),
                "record_type": head["warc-type"],
                "payload_bytes": int(head.get("x-payload-length", 0)),
                "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:"),
                "refers_to": _page(refers) if refers else None,
            },
            int(head["content-length"]),
            file,
        )


def _page(record_id: str) -> int | None:
    number = record_id.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def skip(stream, length: int) -> None:
    while length > 0 and (got := len(stream.read(min(length, 1 << 16)))):
        length -= got


def digest(stream, length: int) -> tuple[int, str]:
    """Length and SHA-1 of a block, a piece at a time and never decoded."""
    found, size = hashlib.sha1(), 0
    while size < length and (part := stream.read(min(length - size, 1 << 16))):
        found.update(part)
        size += len(part)
    return size, found.hexdigest()


def read_warc(spark: SparkSession, path: str, payload: str = "full") -> DataFrame:
    """The records of all archives under ``path``. Predicates on header columns are pushed to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path").orderBy("path")
    return spark.read.format("warc").options(files=json.dumps([r[0] for r in files.collect()]), payload=payload).load()


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, "digest").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_FROM} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to
FROM f
"""
