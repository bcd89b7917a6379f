"""Operator 7: embedding near-duplicates with a pivot-permutation index.

Reference points (pivots) are taken from a bounded sample, no two of them alike.
Every vector is described by its nearest pivots in order; inverted lists by pivot
bring together the vectors that share one, shared pivots are counted, and pairs
with enough of them are verified by their cosine in double precision. A pair is
verified only in the list of its smallest shared pivot.

Equal vectors are one entry of the index. Long lists are cut into chunks whose
pairs are separate groups, so a large group of near copies is spread over many
tasks; a group returns link counts and a spanning forest, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmatch.llm.common import written
from salesmatch.llm.components import components

#: Nearest pivots that describe a vector, and how many a pair must share.
NEAREST, SHARED = 12, 2
#: One pivot for so many vectors, at most MAX_PIVOTS; the sample holds SAMPLE times as many vectors. Up to
#: PER_PIVOT * MAX_PIVOTS (a million) vectors a list's length, and with it the comparisons for each vector, does not grow
#: with the table; beyond, lists grow with it. The pivots are broadcast: 65,536 vectors at most.
PER_PIVOT, MAX_PIVOTS, SAMPLE = 16, 1 << 16, 4
#: Sampled vectors compared at once with the pivots chosen so far.
_BLOCK = 512
#: Pivots are less alike than this cosine.
ALIKE = 0.7
#: Vectors of a list compared at once.
CHUNK = 1024


def valid(v):
    """Whether the array column can be compared: not null, not zero, all components finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """id (64-bit hash), first (smallest vec_id), copies and vector of every distinct valid vector."""
    return rows.where(valid(F.col("vector"))).groupBy("id", "vector").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"))


def choose_pivots(vectors: DataFrame, seed: int = 7) -> np.ndarray:
    """Unit vectors of the pivots, from a sample of at most SAMPLE * MAX_PIVOTS vectors in hash order."""
    n = vectors.count()
    wanted = min(MAX_PIVOTS, max(16, n // PER_PIVOT))
    sample = vectors.orderBy(F.xxhash64(F.lit(seed), "id")).limit(SAMPLE * wanted).select("vector").toArrow()
    return spread(_unit(sample.column(0).combine_chunks()), wanted)


def spread(x: np.ndarray, wanted: int, alike: float = ALIKE) -> np.ndarray:
    """The first ``wanted`` rows, in order, that are less alike than ``alike`` to every earlier one taken."""
    kept = np.empty((0, x.shape[1]))
    for i in range(0, len(x), _BLOCK):
        part = x[i:i + _BLOCK]
        if len(kept):
            part = part[(part @ kept.T).max(1) < alike]
        among = part @ part.T
        taken: list[int] = []
        for k in range(len(part)):
            if len(kept) + len(taken) == wanted:
                break
            if not taken or among[k, taken].max() < alike:
                taken.append(k)
        kept = np.concatenate((kept, part[taken]))
        if len(kept) == wanted:
            break
    return kept


def comparisons(vectors: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> int:
    """Pairs that stand together in the lists of unit vectors: what the index compares."""
    length = np.bincount(permutations(vectors, pivots, nearest).ravel(), minlength=len(pivots))
    return int((length * (length - 1) // 2).sum())


def _unit(lists) -> np.ndarray:
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    n = len(lists)
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))
    x = x / np.abs(x).max(1, keepdims=True) if n else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def permutations(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots of each unit vector, nearest first."""
    k = min(nearest, len(pivots))
    out = np.empty((len(x), k), np.int32)
    for i in range(0, len(x), 2048):
        s = -(x[i:i + 2048] @ pivots.T)
        top = np.argpartition(s, k - 1, axis=1)[:, :k]
        out[i:i + 2048] = np.take_along_axis(top, np.argsort(np.take_along_axis(s, top, 1), 1, kind="stable"), 1)
    return out


def shared_pivots(a: np.ndarray, b: np.ndarray, pivot: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of pivots that each pair of permutations shares, and of those below ``pivot``."""
    total = np.zeros((len(a), len(b)), np.int16)
    below = np.zeros((len(a), len(b)), bool)
    for j in range(a.shape[1]):
        same = (a[:, j, None, None] == b[None]).any(-1)
        total += same
        below |= same & (a[:, j] < pivot)[:, None]
    return total, below


def _roots(pairs: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each entry's component in a symmetric matrix of links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root, np.where(pairs, root[None], n).min(1))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _links(vectors: DataFrame, threshold: float, nearest: int, shared: int) -> DataFrame:
    """Rows (a, n): a has n links; rows (a, b): a and b are connected."""
    pivots = vectors.sparkSession.sparkContext.broadcast(choose_pivots(vectors))  # at most MAX_PIVOTS vectors

    def describe(batches):
        for b in batches:
            perm = permutations(_unit(b.column("vector")), pivots.value, nearest)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("copies"), b.column("vector"),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(perm) + 1) * perm.shape[1], pa.int32()), pa.array(perm.ravel()))],
                ["id", "copies", "vector", "perm"])

    kind = vectors.schema["vector"].dataType.simpleString()
    index = written(vectors.select("id", "copies", "vector").mapInArrow(
        describe, f"id long, copies long, vector {kind}, perm array<int>"), "pivot_index")
    length = {r.pivot: r.n for r in index.select(F.explode("perm").alias("pivot")).groupBy("pivot").agg(
        F.count("*").alias("n")).collect()}  # a row for each pivot
    chunks = np.ones(max(length, default=0) + 1, np.int64)
    for p, n in length.items():
        chunks[p] = -(-n // CHUNK)

    def post(batches):
        for b in batches:
            perm = b.column("perm").flatten().to_numpy().reshape(b.num_rows, -1)
            ids = b.column("id").to_numpy().view(np.uint64)
            rows, pivot = np.repeat(np.arange(len(ids)), perm.shape[1]), perm.ravel().astype(np.int64)
            own = ((ids[rows] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % chunks[pivot]
            copies = chunks[pivot]
            at = np.repeat(np.arange(len(rows)), copies)
            other = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            low, high = np.minimum(own[at], other), np.maximum(own[at], other)
            for k in range(0, len(at), 4096):
                part = at[k:k + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pivot[part]), pa.array(low[k:k + 4096]), pa.array(high[k:k + 4096]), pa.array(own[part]),
                     *(b.column(c).take(pa.array(rows[part])) for c in ("id", "copies", "vector", "perm"))],
                    ["pivot", "low", "high", "own", "id", "copies", "vector", "perm"])

    def compare(key, table):
        pivot, low, high = (k.as_py() for k in key)
        own = table.column("own").to_numpy()
        left = np.flatnonzero(own == low)
        right = left if low == high else np.flatnonzero(own == high)
        table = table.combine_chunks()
        x = _unit(table.column("vector"))
        perm = table.column("perm").combine_chunks()
        perm = (perm.chunk(0) if isinstance(perm, pa.ChunkedArray) else perm).flatten().to_numpy().reshape(len(own), -1)
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        links = np.zeros((len(own), len(own)), bool)
        for i in range(0, len(left), 256):
            rows = left[i:i + 256]
            total, below = shared_pivots(perm[rows], perm[right], pivot)
            near = (total >= min(shared, perm.shape[1])) & ~below
            near &= x[rows] @ x[right].T >= threshold
            links[np.ix_(rows, right)] |= near
        links |= links.T
        np.fill_diagonal(links, False)
        count = links @ copies
        root = _roots(links, len(own))
        some, tied = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(own)))
        return pa.table({"a": np.concatenate((ids[some], ids[tied])),
                         "b": pa.array(np.concatenate((ids[some], ids[root[tied]]))),
                         "n": np.concatenate((count[some], np.zeros(len(tied), np.int64)))})

    posted = index.mapInArrow(post, f"pivot long, low long, high long, own long, id long, copies long, vector {kind}, "
                                    "perm array<int>")
    return posted.groupBy("pivot", "low", "high").applyInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.9,
                    nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing; vectors of different length are not compared. Equal vectors are
    links of each other. Repeated ids are separate rows; a null id names a
    component only if it has no other. Extra columns are ignored.
    """
    rows = written(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"),
                                  F.xxhash64(vector).alias("id")), "vectors")
    entries = written(distinct_vectors(rows), "entries")
    found = None
    for r in sorted(entries.select(F.size("vector").alias("n")).distinct().collect()):  # lengths of vectors
        part = _links(entries.where(F.size("vector") == r.n), threshold, nearest, shared)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    found = written(found, "found")
    count = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "id")
    tied = components(found.where("a <> b").select("a", "b"))
    named = entries.select("id", "first", "copies").join(tied, F.col("id") == F.col("node"), "left").withColumn(
        "root", F.coalesce("component", "id"))
    name = named.groupBy("root").agg(F.min("first").alias("component_id"))
    out = named.join(name, "root").join(count, "id", "left").select(
        "id", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = rows.select("vec_id", F.when(valid(F.col("vector")), F.col("id")).alias("id"))
    return rows.join(out, "id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
