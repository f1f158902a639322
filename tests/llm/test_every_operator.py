"""What holds for every operator: one row per row, also for odd tables; empty tables; clashing columns."""

import pytest
from pyspark.sql import functions as F

from photolith.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import LONG, ODD

DOCUMENT_QUERIES = [n for n in QUERIES if n not in ("op4_html_text", "op5_warc")]
#: One row per word, not per document.
WORD_QUERIES = ["op12_spelling"]


@pytest.mark.parametrize("name", [n for n in DOCUMENT_QUERIES if n not in WORD_QUERIES])
def test_odd_rows_each_get_a_row(spark, make, name):
    folder = make(documents=ODD, labels=[(4, 1, 0), (6, 0, 1), (None, 1, 1), (5, None, None)])
    got = QUERIES[name](spark, folder).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in ODD), key=str)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables_give_no_rows(spark, make, name):
    assert QUERIES[name](spark, make()).count() == 0


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_clashing_columns_do_not_matter(spark, make, tmp_path, name):
    folder = make(documents=ODD[:6], labels=[(4, 1, 0)])
    clash = ["key", "size", "taken", "score", "target", "range", "piece", "n", "component", "toxic", "quality", "kept", "shingles", "word", "near", "fingerprint", "choice", "row", "pairs"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.select("*", *[F.lit("clash").alias(c) for c in clash]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    plain, clashing = (sorted(map(str, QUERIES[name](spark, f).collect())) for f in (folder, str(tmp_path)))
    assert plain == clashing


PAGE_QUERIES = ["op4_html_text", "op5_warc"]
ODD_PAGES = [
    (1, "u", None), (2, None, ""), (3, "v", "<p>" + LONG + "</p>"), (3, "v", "<p>" + LONG + "</p>"), (4, "w", "<p>" + LONG + "</p>"), (None, "x", "<p>" + LONG + "</p>"),
    (5, "y", "no markup"), (6, "z", "<<p <p>a</p"), (None, None, None), (7, "�", "<p>� 日本 😀 &amp; &#0; &bogus;</p>"),
]


@pytest.mark.parametrize("name", PAGE_QUERIES)
def test_odd_pages_each_get_a_row(spark, make, name):
    got = QUERIES[name](spark, make(pages=ODD_PAGES)).collect()
    assert sorted((r["page_id"] for r in got), key=str) == sorted((r[0] for r in ODD_PAGES), key=str)
    if name == "op5_warc":
        told = [(r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] > 1000]
        assert sorted(told, key=str) == [(3, "revisit", 4), (3, "revisit", 4), (4, "response", None), (None, "response", None)]
    else:
        assert {r["page_id"]: r["text"] for r in got if r["page_id"] in (1, 2, 4, 5)} == {1: "", 2: "", 4: LONG, 5: "no markup"}


@pytest.mark.parametrize("name", PAGE_QUERIES)
def test_clashing_columns_of_pages_do_not_matter(spark, make, tmp_path, name):
    folder = make(pages=ODD_PAGES[:7])
    clash = ["text", "payload", "payload_bytes", "payload_digest", "refers_to", "record_type", "_first", "_n", "_salt", "value", "n_chars"]
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    pages.select("*", *[F.lit("clash").alias(c) for c in clash]).write.parquet(str(tmp_path / "pages.parquet"))
    plain, clashing = (sorted(map(str, QUERIES[name](spark, f).collect())) for f in (folder, str(tmp_path)))
    assert plain == clashing


def test_warc_query_agrees_with_its_sql_on_odd_pages(spark, make):
    import duckdb

    folder = make(pages=ODD_PAGES)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["op5_warc"])
    got = QUERIES["op5_warc"](spark, folder).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_queries_have_their_numbers():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
