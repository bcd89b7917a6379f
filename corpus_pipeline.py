"""The corpus pipeline: quality rules, line dedup, near-duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage
before it kept. All but the last return the columns of ``docs``; the last returns
the pieces of the packed sequences. ``run`` writes each stage's result to the
shared folder and reads it back.

Rows without a doc_id cannot be told to be copies and stay in the near-duplicate
stage; rows that share a doc_id but have unrelated texts stay too. Null texts fail the quality rules. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmatch.llm import bestfit, linededup, quality, secretscan, simhash
from salesmatch.llm.common import text_or_empty, written

#: Tokens of a packed sequence and the id that ends a document.
SEQUENCE, END = 2048, 0


def _with_text(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of struct ``doc`` with a new text; n_chars follows it. A null text stays null."""
    new = F.when(F.col("doc.text").isNull(), F.lit(None)).otherwise(F.col(text))
    changed = {"text": new, "n_chars": F.when(new.eqNullSafe(F.col("doc.text")), F.col("doc.n_chars")).otherwise(
        F.char_length(new).cast("long"))} if "n_chars" in columns else {"text": new}
    return rows.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The text is sent to Python once, beside the other columns."""
    others = F.struct(*[c for c in docs.columns if c != "text"])
    judged = quality.judge(docs.select(others.alias("doc"), "lang", "text"), ["doc"], carry=True).where("kept")
    return judged.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go."""
    return _with_text(linededup.dedup_lines(docs), docs.columns, "kept")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays, once."""
    firsts = simhash.firsts(docs, shingle=3, distance=2).select(F.col("doc_id").alias("id"), F.col("row").alias("row"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"),
                       F.xxhash64(text_or_empty()).alias("row"))
    kept = rows.join(firsts, ["id", "row"], "left_semi").dropDuplicates(["id", "row"])
    return kept.select("doc.*").union(docs.where("doc_id is null"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return _with_text(secretscan.masked(docs), docs.columns, "clean")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return bestfit.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=END, capacity=SEQUENCE)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_duplicates", near_duplicate_stage),
          ("secrets", secret_stage), ("packing", packing_stage)]

#: The perplexity model and the forest have no SQL twin; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
