"""Queries of this subpackage over the whole given tables, with production parameters."""

from __future__ import annotations

import public_tokenizers

from salesmatch.llm import (bestfit, bpe, htmltext, licenses, linededup, pivots, quality, resampling, secretscan, simhash,
                            tokenfiles, vectorcodes, warc)
from salesmatch.llm.registry import ORACLE, QUERIES, query, table  # noqa: F401

#: Tokens of a packed sequence.
SEQUENCE = 2048


@query("op2_bpe")
def op2(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op9_token_files")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = tokenfiles.write_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokenfiles.digests(spark, path)


@query("op10_best_fit")
def op10(spark, sf_dir):
    return bestfit.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  end_id=0, capacity=SEQUENCE)


@query("op1_simhash")
def op1(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)


@query("op3_line_dedup", linededup.SQL)
def op3(spark, sf_dir):
    return linededup.line_digests(table(spark, sf_dir, "documents"))


@query("op8_quality")
def op8(spark, sf_dir):
    return quality.verdicts(table(spark, sf_dir, "documents"))


@query("op6_licenses", licenses.sql())
def op6(spark, sf_dir):
    return licenses.license_rows(table(spark, sf_dir, "documents"))


@query("op5_html_text")
def op5(spark, sf_dir):
    return htmltext.main_text(table(spark, sf_dir, "pages"))


@query("op7_embeddings")
def op7(spark, sf_dir):
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


@query("op4_secrets")
def op4(spark, sf_dir):
    return secretscan.secret_rows(table(spark, sf_dir, "documents"))


@query("op11_vector_codes", vectorcodes.sql())
def op11(spark, sf_dir):
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


@query("op12_warc", warc.SQL)
def op12(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op13_resample", resampling.SQL)
def op13(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
