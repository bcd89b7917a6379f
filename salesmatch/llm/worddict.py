"""Tokenise documents by a shuffle of distinct words.

1. Each task cuts its documents into blocks (``wordblocks``) and sends every
   distinct word of a block, once, to the bucket of the word's hash. The
   positions travel as dictionary numbers.
2. A bucket meets all copies of a word, encodes each distinct word once, and
   sends the ids back to the blocks.
3. The documents of a block, as lists of dictionary numbers, meet the block's
   ids and are put together by position.

Rows shuffled grow with the distinct words of the blocks, never with the
occurrences of a word; no table of all words is broadcast or collected. Blocks
are identified by their content: if a recomputed task ever saw its rows in
another order, step 3 fails with a message instead of mixing words up.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmatch.llm import packing, wordblocks
from salesmatch.llm.common import shuffle_width, text_or_empty

#: Words put together at once, to bound memory.
_SLICE = 1 << 19
#: Distinct words of a bucket whose ids a task remembers; beyond it they are encoded again.
_KNOWN = 1 << 20


def encode_documents(docs: DataFrame, key: list[str], text: str, spans: Callable,
                     make_encoder: Callable[[], Callable[[list[bytes]], list[list[int]]]],
                     make_finish: Callable[[], Callable[[pa.Table], pa.Table]] | None = None,
                     finished: T.StructType | None = None) -> DataFrame:
    """``key`` columns and ``ids``, the document's token ids as little-endian uint16 bytes.

    ``spans`` cuts a text into words (``wordblocks.word_spans`` or
    ``chunk_spans``); ``make_encoder`` is called once a task and returns a
    function from words to lists of ids (below 65536). Nulls: a null text is an
    empty one and has no ids; key columns may hold nulls and repeats, every row
    gives one row.

    ``make_finish``, called once a task, returns a function from such a table to
    one of schema ``finished``. It runs in the worker that puts the ids together,
    which saves a task further workers for what follows.
    """
    names = [f"_k{i}" for i in range(len(key))]
    rows = docs.select(*[F.col(k).alias(n) for k, n in zip(key, names)], text_or_empty(text).alias("_text"))
    buckets = shuffle_width(docs.sparkSession)

    def words_out(batches):
        for _, b in wordblocks.blocks(batches, "_text", spans):
            bucket = (b.hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = []
            for k in range(buckets):
                at = order[edges[k]:edges[k + 1]]
                if len(at):
                    lens, words = b.joined(at)
                    out.append((b.key, k, packing.pack_rising(at), packing.pack_ints(lens), packing.pack_bytes(words)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary(),
                                                               pa.binary()))],
                    ["block", "bucket", "at", "lens", "words"])

    def encoded(batches):
        encode, known = make_encoder(), {}
        for batch in batches:
            out = []
            for block, at, lens, data in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "lens", "words"))):
                edge, buf = packing.offsets(packing.unpack_ints(lens)).tolist(), packing.unpack_bytes(data)
                words = [buf[i:j] for i, j in zip(edge, edge[1:])]
                if len(known) > _KNOWN:
                    known.clear()
                ids = list(map(known.get, words))
                new = [i for i, x in enumerate(ids) if x is None]
                for i, x in zip(new, encode([words[i] for i in new])):
                    ids[i] = known[words[i]] = x
                flat = np.fromiter(chain.from_iterable(ids), np.uint32)
                if len(flat) and flat.max() > 65535:
                    raise ValueError(f"token id {flat.max()} does not fit 16 bits")
                out.append((block, at, packing.pack_ints(np.array([len(x) for x in ids])), packing.pack_ints(flat)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                    ["block", "at", "n", "ids"])

    def docs_out(batches):
        for parts, b in wordblocks.blocks(batches, "_text", spans):
            table = pa.Table.from_batches(parts).select(names).combine_chunks()
            whole = pa.array([0, table.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(whole, c.chunk(0)) for c in table.columns]
            yield pa.RecordBatch.from_arrays(
                [*lists, pa.array([b.key]), pa.array([packing.pack_ints(np.diff(b.doc_at))], pa.binary()),
                 pa.array([packing.pack_ints(b.index)], pa.binary())], [*names, "block", "sizes", "index"])

    finish: list[Callable] = []

    def assembled(left: pa.Table, right: pa.Table) -> pa.Table:
        at = [packing.unpack_rising(x) for x in right.column("at").to_pylist()]
        n = [packing.unpack_ints(x) for x in right.column("n").to_pylist()]
        ids = [packing.unpack_ints(x).astype(np.uint16) for x in right.column("ids").to_pylist()]
        words = max((int(x[-1]) + 1 for x in at), default=0)
        count = np.zeros(words, np.int64)
        begin = np.zeros(words, np.int64)
        found = np.zeros(words, bool)
        base = 0
        for a, c in zip(at, n):
            edge = packing.offsets(c)
            count[a], begin[a], found[a] = c, base + edge[:-1], True
            base += int(edge[-1])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
        keys: list[list] = [[] for _ in names]
        out = []
        for i in range(left.num_rows):  # one row, or more if blocks of the same content exist
            index = packing.unpack_ints(left.column("index")[i].as_py()).astype(np.int64)
            doc_at = packing.offsets(packing.unpack_ints(left.column("sizes")[i].as_py()))
            if len(index) and (index.max() >= words or not found[index].all()):
                raise RuntimeError("a block's words are missing: its input rows changed order between two reads")
            d = 0
            while d + 1 < len(doc_at):  # documents with about _SLICE words together
                e = max(d + 1, int(np.searchsorted(doc_at, doc_at[d] + _SLICE, "right")) - 1)
                part = index[doc_at[d]:doc_at[e]]
                total = packing.offsets(count[part])
                values = flat[np.arange(total[-1]) + np.repeat(begin[part] - total[:-1], np.diff(total))]
                edge = total[doc_at[d:e + 1] - doc_at[d]].tolist()
                out.extend(values[x:y].tobytes() for x, y in zip(edge, edge[1:]))
                d = e
            for own, n in zip(keys, names):
                own.append(left.column(n).combine_chunks()[i].values)
        columns = [pa.concat_arrays(own) if own else pa.nulls(0) for own in keys]
        table = pa.table([*columns, pa.array(out, pa.binary())], [*key, "ids"])
        if make_finish is None:
            return table
        if not finish:
            finish.append(make_finish())
        return finish[0](table)

    kept = [T.StructField(n, docs.schema[k].dataType) for k, n in zip(key, names)]
    sent = rows.select("_text").mapInArrow(words_out, "block long, bucket int, at binary, lens binary, words binary")
    back = sent.repartition(buckets, "bucket").mapInArrow(encoded, "block long, at binary, n binary, ids binary")
    lists = rows.mapInArrow(docs_out, T.StructType([
        *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in kept], T.StructField("block", T.LongType()),
        T.StructField("sizes", T.BinaryType()), T.StructField("index", T.BinaryType())]))
    plain = T.StructType([*(T.StructField(k, f.dataType) for k, f in zip(key, kept)), T.StructField("ids", T.BinaryType())])
    return lists.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        assembled, plain if finished is None else finished)
