"""The registered queries without an oracle on the given tables: one row for each row of their table, with whole keys."""

import os
import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
#: Query, its table and the key that every row of the table has in the result.
WHOLE = [("op1_simhash", "documents", "doc_id"), ("op2_bpe", "documents", "doc_id"), ("op5_html_text", "pages", "page_id"),
         ("op7_embeddings", "embeddings", "vec_id"), ("op8_quality", "documents", "doc_id"), ("op9_token_files", "documents", "doc_id")]


@pytest.mark.parametrize("name,table,key", WHOLE)
def test_every_row_has_its_result(spark, name, table, key):
    want = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    got = E.queries()[name](spark, SF)
    assert sorted(r[0] for r in got.select(key).collect()) == want


def test_pieces_cover_every_document(spark):
    pieces = E.queries()["op10_best_fit"](spark, SF).collect()
    docs = {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {p.doc_id for p in pieces} == docs and all(0 < p.length <= 2048 for p in pieces)
    ends = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends.get(p.sequence_id, 0)  # gapless
        ends[p.sequence_id] = p.offset + p.length
    assert max(ends.values()) <= 2048


def test_planted_secrets_are_flagged_and_others_left(spark):
    """The given texts hold their secrets as token = "..."; nothing else in them is one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    planted = {(r.doc_id, v) for r in docs for v in re.findall(r'token = "([^"]+)"', r.text or "")}
    found = E.queries()["op4_secrets"](spark, "/root/testdata/sf0.01").collect()
    assert planted and {(r.doc_id, r.value) for r in found if r.is_secret} == planted
    assert {r.is_secret for r in found} == {True, False}


def test_pipeline_keeps_documents_of_the_table(spark):
    docs = {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    kept = {p.doc_id for p in E.queries()["pipeline"](spark, SF).collect()}
    assert kept <= docs and 2 * len(kept) > len(docs)


def test_every_query_is_covered():
    rows_only = set(E.queries()) - set(E.oracle_sql())
    assert rows_only == {n for n, _, _ in WHOLE} | {"op10_best_fit", "op4_secrets", "pipeline"}
