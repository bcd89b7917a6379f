"""Operator 1: SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are cut into partitions of correlated bits. If two fingerprints
differ in at most t bits and the partitions' thresholds add up to
t - partitions + 1 (a threshold of -1 leaves a partition out), at least one
partition differs in no more bits than its threshold. For every fingerprint a
dynamic program shares the thresholds out at the least estimated number of
probes and candidates; it then probes the index of partition values and verifies
the bit distance.

A slot of the index with more than ``DENSE`` fingerprints (a large group of near
copies) would give a quadratic number of pairs. All fingerprints that probe or
fill such a slot are linked exactly in linear size instead: two fingerprints
within t bits share a value that is t/2 bits from both, so every fingerprint
lists the values around it and hangs on the smallest fingerprint of each.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmatch.llm.common import text_or_empty, tidy, written
from salesmatch.llm.components import components

#: A slot with more fingerprints has more pairs than its fingerprints have near values.
DENSE = 130
#: Bits of a sub-partition whose values are counted for the estimate.
SUB_BITS = 11
_SEED = 42


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of a text's word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
        h = np.array([xxhash.xxh64_intdigest(g, _SEED) for g in grams], np.uint64)
    else:
        flat = memoryview(b" ".join(words))
        end, ends = -1, []
        for w in words:
            end += len(w) + 1
            ends.append(end)
        starts = [0, *(e + 1 for e in ends)]
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(flat[i:j], _SEED) for i, j in zip(starts, ends[shingle - 1:])], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k:k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(ones * 2 > len(h)).tolist()))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, ``row`` (hash of the text) and ``fp`` (the fingerprint's 64 bits as a long) of every row."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.encode(), shingle) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "row", "fp"])

    body = text_or_empty(text)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("row"), body.alias("t")).mapInArrow(
        tidy(run), "doc_id long, row long, fp long")


def _bits(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits of each fingerprint as one number."""
    out = np.zeros(len(fp), np.int64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def _counts(fps: DataFrame, count) -> dict[int, int]:
    """Sum over all fingerprints what ``count`` (an array of bounded length) returns for a batch."""

    def run(batches):
        total = None
        for b in batches:
            part = count(b.column(0).to_numpy().view(np.uint64))
            total = part if total is None else total + part
        if total is not None:
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total[cell], pa.int64())], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    return {r.cell: r.n for r in rows}


def correlated_groups(fps: DataFrame, parts: int) -> list[list[int]]:
    """Cut the 64 bits into ``parts`` groups of like size, correlated bits together."""

    def pairs(fp):
        ones = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        return np.append((ones.T @ ones).astype(np.int64).ravel(), len(fp))

    cell = _counts(fps, pairs)
    n = max(1, cell.get(4096, 0))
    both = np.array([cell.get(k, 0) for k in range(4096)], float).reshape(64, 64) / n
    p = both.diagonal()
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        seed = max(sorted(left), key=lambda b: corr[b, sorted(left)].max())
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


class Allocator:
    """Shares thresholds out to the partitions of each fingerprint.

    The number of fingerprints within e bits in a partition is estimated from
    counts of its sub-partitions' values, taken as independent.
    """

    def __init__(self, fps: DataFrame, groups: list[list[int]], distance: int):
        self.groups, self.distance = groups, distance
        self.subs = [[g[i:i + SUB_BITS] for i in range(0, len(g), SUB_BITS)] for g in groups]
        flat = [s for subs in self.subs for s in subs]
        cell = _counts(fps, lambda fp: np.concatenate(
            [np.bincount(_bits(fp, s), minlength=1 << SUB_BITS) for s in flat]))
        table = np.zeros(len(flat) << SUB_BITS)
        table[list(cell)] = list(cell.values())
        table = table.reshape(len(flat), -1)
        self.total = max(1.0, table[0].sum())
        self.near = []
        for s, row in zip(flat, table):
            at = np.arange(1 << SUB_BITS)
            self.near.append(np.stack([sum(row[at ^ sum(1 << b for b in c)] for c in combinations(range(len(s)), e))
                                       if e <= len(s) else 0 * row for e in range(distance + 1)], 1) / self.total)

    def thresholds(self, fp: np.ndarray) -> np.ndarray:
        """One threshold for each fingerprint (row) and partition, -1 to distance, adding up to
        distance - partitions + 1."""
        t, parts, n, s = self.distance, len(self.groups), len(fp), 0
        cost = np.zeros((parts, t + 2, n))  # by threshold + 1
        for i, subs in enumerate(self.subs):
            spread = np.zeros((n, t + 1))
            spread[:, 0] = 1
            for bits in subs:
                own = self.near[s][_bits(fp, bits)]
                spread = np.stack([sum(spread[:, d] * own[:, e - d] for d in range(e + 1)) for e in range(t + 1)], 1)
                s += 1
            for e in range(t + 1):
                probes = sum(1 for k in range(e + 1) for _ in combinations(range(len(self.groups[i])), k))
                cost[i, e + 1] = probes + self.total * spread[:, :e + 1].sum(1)
        # least[k]: over the partitions so far, with thresholds + 1 adding up to k
        least = np.full((t + 2, n), np.inf)
        least[0] = 0
        chosen = np.zeros((parts, t + 2, n), np.int64)
        for i in range(parts):
            after = np.full((t + 2, n), np.inf)
            for k in range(t + 2):
                for e in range(k + 1):
                    c = least[k - e] + cost[i, e]
                    better = c < after[k]
                    after[k][better], chosen[i, k][better] = c[better], e
            least = after
        out, k = np.zeros((n, parts), np.int64), np.full(n, t + 1)
        for i in reversed(range(parts)):
            e = chosen[i][k, np.arange(n)]
            out[:, i], k = e - 1, k - e
        return out


def _slots(fp: np.ndarray, groups: list[list[int]], thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every probe; a slot is a partition and a value of its bits."""
    rows, slots = [], []
    for i, bits in enumerate(groups):
        value = _bits(fp, bits)
        for e in range(int(thresholds[:, i].max(initial=-1)) + 1):
            at = np.flatnonzero(thresholds[:, i] >= e)
            for flip in combinations(range(len(bits)), e):
                rows.append(at)
                slots.append((i << 56) | (value[at] ^ sum(1 << b for b in flip)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(slots)


def links(fps: DataFrame, distance: int, parts: int | None = None, dense: int = DENSE) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints (column ``fp``) that connect exactly
    those reachable by links of at most ``distance`` differing bits; every edge is such a link.

    ``fps`` holds no nulls and no repeats (texts without words share fingerprint 0, once); other columns are
    ignored; an empty table gives no edges."""
    groups = correlated_groups(fps, parts or distance + 1)
    allot = Allocator(fps, groups, distance)
    batch_rows = 20_000

    def probe(batches, own: bool):
        for b in batches:
            for at in range(0, b.num_rows, batch_rows):
                fp = b.column(0).slice(at, batch_rows).to_numpy().view(np.uint64)
                need = np.zeros((len(fp), len(groups)), np.int64) if own else allot.thresholds(fp)
                rows, slots = _slots(fp, groups, need)
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(fp[rows].view(np.int64))], ["slot", "fp"])

    index = fps.select("fp").mapInArrow(lambda x: probe(x, True), "slot long, fp long")
    probes = written(fps.select("fp").mapInArrow(lambda x: probe(x, False), "slot long, fp long"), "probes")
    index = written(index, "index")
    hot = written(index.groupBy("slot").count().where(F.col("count") > dense).select("slot"), "hot")
    pairs = probes.join(hot, "slot", "left_anti").withColumnRenamed("fp", "a").join(
        index.withColumnRenamed("fp", "b"), "slot").where(
        (F.col("b") < F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    crowded = probes.union(index).join(hot, "slot", "left_semi").select("fp").distinct()
    inner, outer = distance // 2, distance - distance // 2

    def around(batches):
        masks = [(sum(1 << b for b in c), e) for e in range(outer + 1) for c in combinations(range(64), e)]
        mask, far = np.array([m for m, _ in masks], np.uint64), np.array([e for _, e in masks], np.int32)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                fp = b.column(0).slice(at, 1000).to_numpy().view(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((fp[:, None] ^ mask).ravel().view(np.int64)), pa.array(np.tile(far, len(fp))),
                     pa.array(np.repeat(fp, len(mask)).view(np.int64))], ["z", "far", "fp"])

    ball = crowded.mapInArrow(around, "z long, far int, fp long")
    # A value has a bounded number of fingerprints around it, so the lists are bounded too.
    stars = ball.groupBy("z").agg(F.min(F.when(F.col("far") <= inner, F.col("fp"))).alias("a"),
                                  F.collect_set("fp").alias("near")).where("a is not null and size(near) > 1")
    stars = stars.select("a", F.explode("near").alias("b")).where("a != b").distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                    distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable by
    links of at most ``distance`` differing bits, the own included) of every row.

    A null text counts as empty: fingerprint 0, linked like any other. A null
    doc_id is never a component's name unless it has no other. Repeated rows give
    one row each; extra columns are ignored; empty tables give empty results.
    """
    rows = written(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    named = _named(rows, distance)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = named.join(least, "root").select("fp", "component_id")
    return rows.join(names, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(rows: DataFrame, distance: int) -> DataFrame:
    """fp, first (smallest doc_id) and root (its component's smallest fingerprint) of every distinct fingerprint."""
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(links(distinct, distance))
    return distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root"))


def firsts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """doc_id and ``row`` (hash of the text, null as empty) of the one document that stands for each component:
    its smallest doc_id, and of rows that share this id the smallest hash. Unrelated texts under one doc_id lie in
    components of their own and are both named. Rows without a doc_id link others but stand for none."""
    rows = written(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    named = _named(rows, distance).select("fp", "root")
    own = rows.where("doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "row")).alias("one"))
    return own.join(named, "fp").groupBy("root").agg(F.min("one").alias("one")).select("one.*")
