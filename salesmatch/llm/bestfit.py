"""Operator 10: best-fit packing of token pieces into sequences.

Method: hierarchical residual packing. Every task packs its pieces by best-fit
decreasing and emits the nearly full bins. Underfull bins become items of the
next round, in which ``FAN_IN`` tasks' bins meet in one, until a single task is
left. A round hands on its small bins and the ``CARRY`` emptiest of the others:
after best fit at most one bin of a task is at most half full, and only such
bins can still fill the others, so a longer list could not be used. What is not
handed on is emitted as it is; nothing is lost.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmatch.llm.common import shuffle_width, written
from salesmatch.llm.packing import offsets, ragged_take
from salesmatch.llm.tokenizers_io import BYTE_PATTERN, make_library_encoder
from salesmatch.llm.wordblocks import chunk_spans
from salesmatch.llm.worddict import encode_documents

FAN_IN = 8
#: More than half full bins handed on by a task of a round.
CARRY = 256
#: A bin with at most this share of its capacity free is nearly full.
NEARLY = 1 / 256
#: Items packed at once by a task of the first round.
ITEMS = 200_000


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, text: str = "text",
               with_tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and packed ``ids`` if asked for) of every piece.

    A document is its tokens and ``end_id``; one longer than ``capacity`` is cut
    into full pieces after a first piece with the remainder. A null text counts
    as empty: one piece with the end id.
    """
    end = np.array([end_id], np.uint16)

    def cut(table: pa.Table) -> pa.Table:
        rows = []
        for doc, data in zip(table.column("doc_id").to_pylist(), table.column("ids").to_pylist()):
            v = np.concatenate((np.frombuffer(data, "<u2"), end))
            raw = v.astype("<u4").tobytes()
            i = 0
            edge = len(v) - (len(v) - 1) // capacity * capacity
            for piece, j in enumerate(range(edge, len(v) + 1, capacity)):
                rows.append((doc, piece, i, j - i, zlib.crc32(raw[4 * i:4 * j]),
                             v[i:j].tobytes() if with_tokens else None))
                i = j
        columns = list(zip(*rows)) or [()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(),
                                                                 pa.int64(), pa.binary()))],
                        ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    long = T.LongType()
    schema = T.StructType([T.StructField("doc_id", long), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", long), T.StructField("length", long),
                           T.StructField("ids_crc32", long), T.StructField("ids", T.BinaryType())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = encode_documents(rows, ["doc_id"], "text", chunk_spans,
                           make_library_encoder(vocabulary, BYTE_PATTERN, False), lambda: cut, schema)
    return out if with_tokens else out.drop("ids")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item numbers. Bit r of ``free`` says that a bin has room r."""
    by_room: dict[int, list[int]] = {}
    free, bins = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            places = by_room[room]
            at = places.pop()
            if not places:
                free ^= 1 << room
            bins[at].append(i)
        else:
            at, room = len(bins), capacity
            bins.append([i])
        room -= size
        if room:
            by_room.setdefault(room, []).append(at)
            free |= 1 << room
    return bins


def pack(items: DataFrame, length: str, capacity: int) -> DataFrame:
    """All columns of ``items`` with sequence_id and offset.

    ``length`` must be between 1 and ``capacity``. Offsets of a sequence run from 0
    without gaps. Ties and repeated rows are separate items.
    """
    cols = items.columns
    bins = items.select(F.col(length).cast("long").alias("fill"), F.array(F.struct(*cols)).alias("members"))
    member = bins.schema["members"].dataType
    tasks = shuffle_width(items.sparkSession)
    done, level = [], 0
    while True:
        last = tasks == 1
        placed = written(_round(bins, member, capacity, level, last), f"bins{level}")
        done.append(placed.where("closed"))
        if last:
            break
        tasks = -(-tasks // FAN_IN)
        bins = placed.where("not closed").select("sequence_id", "fill", "members").repartition(tasks, "sequence_id") \
            .select("fill", "members")
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    pairs = out.select("sequence_id", F.explode(F.arrays_zip("members", "offsets")).alias("m"))
    return pairs.select(*[F.col("m.members")[c].alias(c) for c in cols], "sequence_id",
                        F.col("m.offsets").alias("offset"))


def _round(bins: DataFrame, member: T.DataType, capacity: int, level: int, last: bool) -> DataFrame:
    def close(table: pa.Table, count: int):
        fill = table.column("fill").to_numpy()
        lists = table.column("members").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
        edge, flat = lists.offsets.to_numpy().astype(np.int64), lists.values
        groups = best_fit(fill, capacity)
        order = np.array([i for g in groups for i in g], np.int64)
        take, inner = ragged_take(edge, np.arange(len(flat)), order)
        group_at = inner[offsets(np.array([len(g) for g in groups]))]
        flat = flat.take(pa.array(take))
        place = offsets(flat.field(flat.type.get_field_index("_n")).to_numpy())[:-1]
        place = place - np.repeat(place[group_at[:-1]], np.diff(group_at))
        total = np.add.reduceat(fill[order], offsets(np.array([len(g) for g in groups]))[:-1])
        closed = np.ones(len(groups), bool)
        if not last:
            large = np.flatnonzero((total > capacity // 2) & (capacity - total > capacity * NEARLY))
            closed[total <= capacity // 2] = False
            closed[large[np.argsort(total[large], kind="stable")[:CARRY]]] = False
        ids = (level << 58) + (TaskContext.get().partitionId() << 32) + count + np.arange(len(groups), dtype=np.int64)
        at = pa.array(group_at, pa.int32())
        yield from pa.Table.from_arrays(
            [pa.array(ids), pa.array(total.astype(np.int64)), pa.array(closed), pa.ListArray.from_arrays(at, flat),
             pa.ListArray.from_arrays(at, pa.array(place.astype(np.int64)))],
            ["sequence_id", "fill", "closed", "members", "offsets"]).to_batches(10_000)

    def run(batches):
        parts, size, count = [], 0, 0
        for b in batches:
            parts.append(b)
            size += b.num_rows
            if size >= ITEMS:
                yield from close(pa.Table.from_batches(parts).combine_chunks(), count)
                count, parts, size = count + size, [], 0
        if size:
            yield from close(pa.Table.from_batches(parts).combine_chunks(), count)

    fields = member.elementType.fields
    if level == 0:  # the packer finds a member's length under a fixed name
        bins = bins.select("fill", F.transform("members", lambda m: F.struct(
            *[m[f.name].alias(f.name) for f in fields], F.col("fill").alias("_n"))).alias("members"))
    schema = T.StructType([
        T.StructField("sequence_id", T.LongType()), T.StructField("fill", T.LongType()),
        T.StructField("closed", T.BooleanType()), bins.schema["members"],
        T.StructField("offsets", T.ArrayType(T.LongType()))])
    return bins.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of all documents with their sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut_pieces(docs, vocabulary, end_id, capacity)
    return pack(pieces, "length", capacity)
