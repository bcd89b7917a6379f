"""Operator 2: byte-level BPE encoding and decoding.

Method: a global shuffle of distinct words. Texts are cut at safe places into
words (a white-space run and what follows it); every distinct word of a block
goes once to the bucket of its hash, where each distinct word is encoded once;
the ids go back and are put together by position (``worddict``). Decoding joins
the token-byte table, whose size is bounded by the vocabulary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmatch.llm.packing import offsets
from salesmatch.llm.tokenizers_io import BYTE_PATTERN, load_ranks, make_rank_encoder
from salesmatch.llm.wordblocks import chunk_spans
from salesmatch.llm.worddict import encode_documents


#: Tokens joined with the token-byte table at once.
_JOINED = 1 << 20


def encode(docs: DataFrame, ranks_path: str, key: list[str], text: str = "text",
           pattern: str = BYTE_PATTERN) -> DataFrame:
    """``key`` columns and ``ids``: the text's token ids as little-endian uint16 bytes
    (``id_array`` turns them into an array column).

    Each match of ``pattern`` is merged by itself, without special tokens. A null
    or empty text has no ids. Repeated rows and repeated keys give one row each;
    extra columns are ignored; an empty table gives an empty table.
    """
    return encode_documents(docs, key, text, chunk_spans, make_rank_encoder(ranks_path, pattern))


def id_array(ids: DataFrame, out: str = "tokens") -> DataFrame:
    """Replace the packed ``ids`` by an ``array<int>`` column."""
    rest = [c for c in ids.columns if c != "ids"]

    def run(batches):
        for b in batches:
            v = [np.frombuffer(x, "<u2").astype(np.int32) for x in b.column("ids").to_pylist()]
            flat = np.concatenate(v) if v else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets(np.array([len(x) for x in v])), pa.int32()),
                                             pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), lists], [*rest, out])

    kept = [ids.schema[c] for c in rest]
    return ids.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def _token_bytes(ranks_path: str) -> pa.Array:
    """The token-byte table: one entry for each id of the vocabulary."""
    ranks = load_ranks(ranks_path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.large_binary())


def _decoded(ids: list[bytes], table: pa.Array) -> list[bytes]:
    """The rows' ids, as one column, joined with the table by id; a row's bytes stand together in the result."""
    out, at = [], 0
    while at < len(ids):  # rows with about so many tokens together
        end, size = at, 0
        while end < len(ids) and (end == at or size + len(ids[end]) <= 2 * _JOINED):
            size += len(ids[end])
            end += 1
        flat = np.frombuffer(b"".join(ids[at:end]), "<u2")
        joined = table.take(pa.array(flat))
        _, edge, data = joined.buffers()
        edge = np.frombuffer(edge, np.int64)[joined.offset:joined.offset + len(joined) + 1]
        raw = memoryview(data if data is not None else b"")
        cut = edge[offsets(np.array([len(x) // 2 for x in ids[at:end]]))].tolist()
        out += [bytes(raw[i:j]) for i, j in zip(cut, cut[1:])]
        at = end
    return out


def decode(ids: DataFrame, ranks_path: str, out: str = "decoded") -> DataFrame:
    """Add the binary column ``out``: the bytes of the packed ``ids``.

    The token-byte table (one row per vocabulary entry) is read in every task and
    each batch is joined with it. An unknown id is an error.
    """

    def run(batches):
        table = _token_bytes(ranks_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_decoded(b.column("ids").to_pylist(), table), pa.binary())],
                                             [*b.schema.names, out])

    return ids.mapInArrow(run, T.StructType([*ids.schema.fields, T.StructField(out, T.BinaryType())]))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str = BYTE_PATTERN) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of the ids as little-endian uint32) and
    decoded_sha256 (of the bytes that the ids decode to); ids and bytes stay in the worker."""

    def make_digests():
        table = _token_bytes(ranks_path)

        def digests(rows: pa.Table) -> pa.Table:
            ids = rows.column("ids").to_pylist()
            wide = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in ids]
            return pa.table({
                "doc_id": rows.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in wide], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in wide], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in _decoded(ids, table)], pa.string())})

        return digests

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return encode_documents(rows, ["doc_id"], "text", chunk_spans, make_rank_encoder(ranks_path, pattern),
                            make_digests, schema)
