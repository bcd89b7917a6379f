"""Operator 11: vector code compression (product quantisation) by Lloyd rounds over cover trees.

Vectors become integers and are cut into equal parts; each part has a codebook of
its own. A task packs its vectors in blocks and builds a cover tree for each part
of a block once. A round walks the trees: a node whose nearest entry is, by the
triangle inequality, the nearest of its whole subtree adds the subtree's sum and
size at once; only ambiguous nodes are opened, down to single points that are
compared exactly. Spark sums what the tasks found for each entry; sums, counts and
distances are integers, so the result does not depend on blocks or order.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmatch.llm import covertree
from salesmatch.llm.common import join_hot_keys, written

#: Equal parts of a vector, entries of a codebook, rounds, and the factor before rounding down.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block.
BLOCK = 4096


def usable(v):
    """Whether the array column is not null, not empty and all its components are finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & (F.size(v) > 0), F.lit(False))


def integers(values: np.ndarray, scale: int, length: int) -> np.ndarray:
    """floor(scale * x). Values whose squared distances would not fit a long stop the job."""
    out = np.floor(values.astype(np.float64) * scale)
    if out.size and np.abs(out).max() > math.isqrt((1 << 63) // length) // 2:
        raise OverflowError("vector components too large: squared distances do not fit a long")
    return out.astype(np.int64)


def first_vectors(rows: DataFrame, entries: int) -> list:
    """The vectors of the smallest ``entries`` vec_ids, ascending. Of rows that share a vec_id the smallest
    vector counts; a null vec_id comes last. At most ``entries`` rows are fetched at once."""
    found, left = {}, rows
    while len(found) < entries:
        got = left.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
        for r in got:
            if len(found) < entries:
                found.setdefault(r.vec_id, r.vector)
        if len(got) < entries or got[-1].vec_id is None:
            break
        left = rows.where((F.col("vec_id") > got[-1].vec_id) | F.col("vec_id").isNull())
    return list(found.values())


def _packed(tree: covertree.Tree) -> bytes:
    sizes = [len(tree.order), len(tree.levels), *(len(first) for _, first, _ in tree.levels)]
    parts = [np.array(sizes, np.int32), tree.order.astype(np.int32)]
    for node, first, radius in tree.levels:
        parts += [node.astype(np.int32), first.astype(np.int32), radius.astype(np.float64)]
    return b"".join(p.tobytes() for p in parts)


def _unpacked(data: bytes) -> covertree.Tree:
    at = 0

    def take(n, kind):
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    n, depth = take(2, np.int32).tolist()
    sizes = take(depth, np.int32).tolist()
    order = take(n, np.int32)
    return covertree.Tree(order, [(take(s, np.int32), take(s, np.int32), take(s, np.float64)) for s in sizes])


def pack_blocks(rows: DataFrame, length: int, parts: int = PARTS, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """One row a block: its vec_ids, labels, integer points (32 bits each, row by row) and a tree for each part."""
    label = rows.schema["label"].dataType
    width = length // parts

    def run(batches):
        held, size = [], 0
        for b in batches:
            for at in range(0, b.num_rows, block):
                held.append(b.slice(at, block))
                size += held[-1].num_rows
                while size >= block:
                    table = pa.Table.from_batches(held)
                    yield one(table.slice(0, block))
                    rest = table.slice(block).combine_chunks().to_batches()
                    held, size = rest, size - block
        if size:
            yield one(pa.Table.from_batches(held))

    def one(table):
        table = table.combine_chunks()
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = integers(flat, scale, length).reshape(table.num_rows, length)
        trees = [_packed(covertree.build(x[:, p * width:(p + 1) * width])) for p in range(parts)]
        edge = pa.array([0, table.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(edge, table.column(c).combine_chunks()) for c in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays(
            [*lists, pa.array([x.astype(np.int32).tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary()))],
            ["vec_ids", "labels", "points", "trees"])

    schema = T.StructType([T.StructField("vec_ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)),
                           T.StructField("points", T.BinaryType()), T.StructField("trees", T.ArrayType(T.BinaryType()))])
    return rows.select("vec_id", "label", "vector").mapInArrow(run, schema)


def _parts(points: bytes, trees, length: int):
    """(part, its points as long integers, its tree) of a block."""
    x = np.frombuffer(points, np.int32).reshape(-1, length)
    width = length // len(trees)
    for p, t in enumerate(trees):
        yield p, x[:, p * width:(p + 1) * width].astype(np.int64), _unpacked(t)


def round_sums(blocks: DataFrame, books: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums (parts x entries x width) and counts (parts x entries) of the vectors nearest to each entry of ``books``,
    and the comparisons made. A task sends one number for each component of each entry."""

    def run(batches):
        sums, counts, compared = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64), 0
        for b in batches:
            for points, trees in zip(b.column(0), b.column(1)):
                for p, x, tree in _parts(points.as_py(), trees.as_py(), length):
                    (first, end, entry), rows, own, n = covertree.assign(tree, x, books[p])
                    total = np.zeros((len(x) + 1, x.shape[1]), np.int64)
                    np.cumsum(x[tree.order], axis=0, out=total[1:])
                    np.add.at(sums[p], entry, total[end] - total[first])
                    np.add.at(counts[p], entry, end - first)
                    np.add.at(sums[p], own, x[rows])
                    np.add.at(counts[p], own, 1)
                    compared += n
        out = np.concatenate((sums.ravel(), counts.ravel(), [compared]))
        held = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(out[held])], ["cell", "n"])

    got = blocks.select("points", "trees").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = [0] * (books.size + books.shape[0] * books.shape[1] + 1)
    for r in got.collect():  # at most one row for each component, count and the comparisons
        out[r.cell] = r.n
    sums = np.array(out[:books.size], np.int64).reshape(books.shape)
    return sums, np.array(out[books.size:-1], np.int64).reshape(books.shape[:2]), out[-1]


def coded(blocks: DataFrame, books: np.ndarray, length: int) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    label = blocks.schema["labels"].dataType.elementType

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                codes, error = None, None
                for p, x, tree in _parts(b.column("points")[i].as_py(), b.column("trees")[i].as_py(), length):
                    if codes is None:
                        codes, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
                    (first, end, entry), rows, own, _ = covertree.assign(tree, x, books[p])
                    size = end - first
                    places = np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(int(size.sum()))
                    codes[tree.order[places], p] = np.repeat(entry, size)
                    codes[rows, p] = own
                    diff = x - books[p][codes[:, p]]
                    error += np.einsum("ij,ij->i", diff, diff)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_ids")[i].values, b.column("labels")[i].values,
                     pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["vec_id", "label", "code", "error"])

    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label),
                           T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return blocks.mapInArrow(run, schema)


def lloyd(blocks: DataFrame, books: np.ndarray, length: int, rounds: int = ROUNDS) -> tuple[np.ndarray, list[int]]:
    """The codebooks after ``rounds`` rounds, and the comparisons of each. Unused entries stay."""
    compared = []
    for _ in range(rounds):
        sums, counts, n = round_sums(blocks, books, length)
        compared.append(n)
        books = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
    return books, compared


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row with a usable vector.

    Rows whose vector is null, empty or holds null or non-finite components are
    dropped. All vectors have the length of the smallest vec_id's vector, which must
    divide into ``parts``; rows of another length keep a null code and error and add
    nothing to any sum. Repeated rows are coded each for themselves and count as
    often as they stand; of rows that share one of the smallest vec_ids only the
    smallest vector starts an entry. A null vec_id comes last. Null labels are one
    label. With fewer than ``entries`` vec_ids a codebook has one entry for each.
    Extra columns are ignored; an empty table gives an empty one.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
                          F.col(vector).alias("vector")).where(usable(F.col("vector")))
    start = first_vectors(rows, entries)
    if not start:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    length = len(start[0])
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    start = [v for v in start if len(v) == length]
    fits = F.size("vector") == length
    blocks = written(pack_blocks(rows.where(fits), length, parts, scale), "vector_blocks")
    first = integers(np.array(start, np.float64), scale, length)
    books = np.ascontiguousarray(first.reshape(len(start), parts, length // parts).transpose(1, 0, 2))
    books, _ = lloyd(blocks, books, length, rounds)
    out = written(coded(blocks, books, length), "codes")
    named = digest(books)
    out = join_hot_keys(out, out.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label")
    others = rows.where(~fits).select("vec_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"),
                                      F.lit(None).cast("long").alias("label_error"))
    return out.select("vec_id", "code", "error", "label_error").union(others).withColumn("codebooks_sha256", F.lit(named))


def sql(length: int = 64, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The contract in DuckDB SQL for vectors of one length: one query for each round over all parts and entries."""
    width = length // parts
    near = """SELECT p.part, p.r, p.x, arg_min(e.entry, {d} * 1000 + e.entry) AS entry, min({d}) AS error
  FROM pts p JOIN {book} e ON p.part = e.part GROUP BY p.part, p.r, p.x"""
    d = "list_sum(list_transform(list_zip(p.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for k in range(rounds):
        book, after = f"book{k}", f"book{k + 1}"
        mean = ", ".join(f"((sum(x[{i}]) - ((sum(x[{i}]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"
                         for i in range(1, width + 1))
        steps.append(f"""near{k} AS MATERIALIZED ({near.format(d=d, book=book)}),
mean{k} AS MATERIALIZED (SELECT part, entry, [{mean}] AS x FROM near{k} GROUP BY part, entry),
{after} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN mean{k} m
  ON b.part = m.part AND b.entry = m.entry)""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pts AS MATERIALIZED (SELECT part, r, list_transform(embedding[part * {width} + 1:(part + 1) * {width}],
  lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM v, range({parts}) t(part)),
small AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < {entries}),
book0 AS MATERIALIZED (SELECT part, entry, x FROM pts JOIN small USING (r)),
{", ".join(steps)},
fin AS MATERIALIZED ({near.format(d=d, book=f"book{rounds}")}),
c AS MATERIALIZED (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM fin GROUP BY r),
h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM book{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM v JOIN c USING (r), h
"""
