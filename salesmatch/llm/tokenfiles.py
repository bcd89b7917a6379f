"""Operator 9: token ids in Parquet list columns, read back selectively.

Files hold documents in ascending ``doc_id`` order, one range of ids per file.
``tokens`` is a dictionary-encoded list column (a vocabulary below 65536 needs at
most 16 bits an id); ``doc_id``, ``place`` and ``n_tokens`` are delta-encoded. Row
groups are small enough to skip, and the page indexes that Parquet writes let a
range of documents be read without the other pages. Metadata reads never touch
the token column.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmatch.llm.common import shuffle_width
from salesmatch.llm.packing import offsets
from salesmatch.llm.tokenizers_io import WORD_PATTERN, make_library_encoder
from salesmatch.llm.wordblocks import word_spans
from salesmatch.llm.worddict import encode_documents
from salesmatch.session import shared_dir

#: Row group and page sizes in bytes.
ROW_GROUP, PAGE = 8 << 20, 64 << 10
#: Tokens handed to the file writer at once.
RUN_TOKENS = 1 << 20
_SCHEMA = "doc_id long, part int, place long, n_tokens long, tokens array<int>"


def tokenize(docs: DataFrame, vocabulary: str, end_id: int | None, bounds: list[int], text: str = "text") -> DataFrame:
    """doc_id, part (the number of ``bounds`` below the doc_id; 0 for a null one) and packed ``ids`` (uint16)
    by the tokenizers library, ``end_id`` appended."""
    edge = np.array(bounds, np.int64)
    end = b"" if end_id is None else np.uint16(end_id).tobytes()

    def finish(rows: pa.Table) -> pa.Table:
        doc_id = rows.column("doc_id")
        place = np.searchsorted(edge, doc_id.fill_null(-(1 << 63)).to_numpy())
        ids = [x + end for x in rows.column("ids").to_pylist()]
        return pa.table({"doc_id": doc_id, "part": pa.array(place, pa.int32()), "ids": pa.array(ids, pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return encode_documents(
        rows, ["doc_id"], "text", word_spans, make_library_encoder(vocabulary, WORD_PATTERN, True), lambda: finish,
        T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()),
                      T.StructField("ids", T.BinaryType())]))


def token_runs(edge: np.ndarray):
    """First and last (excluded) document of runs of at most RUN_TOKENS tokens; a longer document is a run of its own."""
    i = 0
    while i + 1 < len(edge):
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + RUN_TOKENS, "right")) - 1)
        yield i, j
        i = j


def write_ids(ids: DataFrame, path: str, parts: int, row_group: int = ROW_GROUP, page: int = PAGE) -> None:
    """Write packed ``ids`` (doc_id, part, ids) by ascending doc_id, one file for each part. Null
    doc_ids come first. Rows with the same doc_id are ordered by their tokens."""

    def rows(batches):
        at = 0
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column("ids").cast(pa.large_binary())
            _, edge, data = column.buffers()
            edge = np.frombuffer(edge, np.int64)[column.offset:column.offset + len(column) + 1] // 2
            flat = np.frombuffer(data or b"", np.uint8)[:2 * edge[-1]].view("<u2")
            for i, j in token_runs(edge):
                own = edge[i:j + 1]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), b.column("part").slice(i, j - i),
                     pa.array(at + own[:-1] - edge[0]), pa.array(np.diff(own)), pa.ListArray.from_arrays(
                         pa.array(own - own[0], pa.int32()), pa.array(flat[own[0]:own[-1]].astype(np.int32)))],
                    ["doc_id", "part", "place", "n_tokens", "tokens"])
            at += int(edge[-1] - edge[0])

    dealt = ids.repartitionById(parts, "part")
    (dealt.sortWithinPartitions("doc_id", "ids").mapInArrow(rows, _SCHEMA).write
     .option("parquet.block.size", row_group).option("parquet.page.size", page)
     .option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false")
     .option("parquet.enable.dictionary#tokens.list.element", "true").option("compression", "zstd").parquet(path))


def range_bounds(docs: DataFrame, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending doc_ids that cut the table into ranges of like size."""
    if parts < 2:
        return []
    cuts = docs.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10_000)).first()[0]
    return sorted(set(cuts or []))


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Documents of an id range with their tokens; row groups and pages outside it are skipped."""
    df = spark.read.schema(_SCHEMA).parquet(path)
    if low is not None:
        df = df.where(F.col("doc_id") >= low)
    if high is not None:
        df = df.where(F.col("doc_id") <= high)
    return df


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, place and n_tokens; the token column is not read."""
    return spark.read.schema(_SCHEMA).parquet(path).select("doc_id", "part", "place", "n_tokens")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens and ids_crc32, all from the files.

    ``start`` adds the tokens of the earlier files (one row per file) to the
    document's place in its own file.
    """

    def crc(batches):
        for b in batches:
            lists = b.column("tokens")
            edge = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<i4")
            raw = memoryview(flat.view(np.uint8))  # ids are not negative: the bytes of unsigned integers
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("part"), b.column("place"), pa.array(np.diff(edge).astype(np.int64)),
                 pa.array([zlib.crc32(raw[4 * i:4 * j]) for i, j in zip(edge.tolist(), edge[1:].tolist())], pa.int64())],
                ["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    totals = read_metadata(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    rows = read_tokens(spark, path).mapInArrow(
        crc, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def write_documents(docs: DataFrame, vocabulary: str, end_id: int | None, path: str | None = None) -> str:
    """Tokenise and write all documents; returns the folder (a new one in the shared folder by default).

    A null text counts as empty and holds only the end id. Extra columns are ignored;
    an empty table writes an empty folder.
    """
    spark = docs.sparkSession
    fresh = path is None
    path = path or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    bounds = range_bounds(docs, shuffle_width(spark))
    write_ids(tokenize(docs, vocabulary, end_id, bounds), path, len(bounds) + 1)
    if fresh:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path
