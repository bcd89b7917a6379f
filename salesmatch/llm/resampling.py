"""Operator 13: importance resampling towards a target distribution.

Both corpora are hashed into the same buckets of word n-grams. A bucket's gain is
the log of its smoothed share in the target over its share in the corpus; the
gains are one array, and a document's weight is the sum of the array at its
features' buckets. Adding Gumbel noise to the weights and taking the highest sums
draws documents without replacement in proportion to the exponentials of the weights.

The draw is a distributed quickselect over the composite key (score descending,
doc_id ascending, row). Each round takes a few pivot keys at random among the
documents still in question and counts exactly how many lie before, at and after
each of them; the range narrows to the piece that holds the k-th key, until a
pivot is that key. Only the winners are sorted and ranked: a range sort, and the
rows of the earlier ranges as offsets.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmatch.llm.common import shuffle_width, text_or_empty, written

#: Hash buckets of features, and the longest run of words that is a feature.
BUCKETS, MAX_GRAM = 10_000, 1
#: Seed of the noise, least words of a document that can be drawn, and the share drawn in hundredths.
SEED, MIN_WORDS, PERCENT = 2024, 20, 10
#: Pivot keys of a round.
PIVOTS = 15
#: Words of one text hashed at once; distinct features whose bucket a task remembers.
_SLICE, _MEMORY = 1 << 18, 1 << 17
_LAST = (1 << 63) - 1

#: A-Z become a-z; bytes below 0x80 other than letters and digits become spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class Buckets:
    """Bucket numbers of features, remembered for frequent ones."""

    def __init__(self, buckets: int, max_gram: int):
        self.buckets, self.max_gram, self.known = buckets, max_gram, {}

    def _of(self, grams: list[bytes]) -> list[int]:
        known = self.known
        if len(known) > _MEMORY:
            known.clear()
        out = list(map(known.get, grams))
        for i, b in enumerate(out):
            if b is None:
                out[i] = known[grams[i]] = zlib.crc32(grams[i]) % self.buckets
        return out

    def features(self, text: bytes):
        """Arrays of the buckets of a whole text's features, in bounded slices of words."""
        words = text.translate(_FOLD).split()
        for at in range(0, len(words), _SLICE):
            part = words[at:at + _SLICE + self.max_gram - 1]
            own = min(_SLICE, len(words) - at)
            out = []
            for n in range(1, self.max_gram + 1):
                grams = part[:own] if n == 1 else [b" ".join(part[i:i + n]) for i in range(min(own, len(part) - n + 1))]
                out += self._of(grams)
            yield len(part[:own]), np.array(out, np.int64)


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, max_gram: int = MAX_GRAM) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends one row for each bucket."""

    def run(batches):
        hashed, total = Buckets(buckets, max_gram), np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column(0):
                for _, f in hashed.features(t.as_py()):
                    total += np.bincount(f, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    rows = docs.select(text_or_empty(text).cast("binary").alias("t")).mapInArrow(run, "bucket long, n long").groupBy(
        "bucket").agg(F.sum("n").alias("n")).collect()  # at most one row for each bucket
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's add-one share in the target to that in the corpus, rounded down."""
    n, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(b) + 1) * float(s + n) / ((int(a) + 1) * float(t + n))))
                     for a, b in zip(raw, target)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text",
             max_gram: int = MAX_GRAM) -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of the gains of its features) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def run(batches):
        gain = shared.value
        hashed = Buckets(len(gain), max_gram)
        for b in batches:
            out = np.zeros((b.num_rows, 3), np.int64)
            for i, t in enumerate(b.column(1)):
                for words, f in hashed.features(t.as_py()):
                    out[i] += words, len(f), gain[f].sum()
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, np.ascontiguousarray(out.T))],
                                             ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the hash of seed and doc_id. A null id hashes like no id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _key() -> list[Column]:
    """Ascending order in which documents are drawn; null ids come last among equal scores."""
    return [(-F.col("score")).alias("low"), F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.col("row")]


def kth_key(scored: DataFrame, k: int, seed: int = SEED, pivots: int = PIVOTS) -> tuple[int, int, int]:
    """The k-th smallest composite key (k from 1) of ``scored`` (score, doc_id, row) by distributed quickselect."""
    keys = scored.select(F.struct(*_key()).alias("key"))
    after, before, skipped = None, None, 0  # the key lies between the first two; so many keys up to ``after``

    def literal(p):
        return F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(p, ("low", "id", "row"))])

    round_ = 0
    while True:
        left = keys
        if after:
            left = left.where(F.col("key") > literal(after))
        if before:
            left = left.where(F.col("key") < literal(before))
        round_ += 1
        drawn = sorted(tuple(r.key) for r in left.orderBy(F.xxhash64(F.lit(seed + round_), "key"), "key").limit(pivots).collect())
        found = left.agg(*[f for i, p in enumerate(drawn) for f in (
            F.count_if(F.col("key") < literal(p)).alias(f"less{i}"), F.count_if(F.col("key") == literal(p)).alias(f"same{i}"))]).first()
        low, high = after, before
        for i, p in enumerate(drawn):
            less, same = skipped + found[f"less{i}"], skipped + found[f"less{i}"] + found[f"same{i}"]
            if less < k <= same:
                return p
            if same < k:
                low, base = p, same
            elif k <= less:
                high = p
                break
        if low is not after:
            skipped = base
        after, before = low, high


def ranked(rows: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """``rows`` with ``rank`` (from 1) by a range sort; only the number of rows of each range goes to the driver."""
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_part", F.shiftright("_at", 33)), "winners")
    before = placed.groupBy("_part").agg(F.count("*").alias("_n")).orderBy("_part").collect()
    offsets = placed.sparkSession.createDataFrame(
        [(r._part, int(o)) for r, o in zip(before, np.cumsum([0, *(r._n for r in before)]))], "_part long, _offset long")
    return placed.join(F.broadcast(offsets), "_part").withColumn(
        "rank", F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_offset")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS,
             max_gram: int = MAX_GRAM) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``.

    Of the rows with at least ``min_words`` words, ``percent`` hundredths (rounded
    down) with the highest scores get ranks from 1; ties go to the smaller doc_id,
    rows that share an id and a score are ordered by their place, null ids come last.
    Others have a null rank. A null text has no words; a null id has the noise of
    an empty id. Extra columns are ignored; empty tables on either side are allowed.
    """
    gain = gains(bucket_counts(docs, text, buckets, max_gram), bucket_counts(target, target_text, buckets, max_gram))
    rows = weighted(docs, gain, doc_id, text, max_gram).withColumn("score", F.col("weight") + noise(seed))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    fit = F.col("n_words") >= min_words
    k = percent * rows.where(fit).count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    last = kth_key(rows.where(fit), k, seed)
    wins = fit & (F.struct(*_key()) <= F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(last, ("low", "id", "row"))]))
    winners = ranked(rows.where(wins), _key(), shuffle_width(docs.sparkSession))
    return winners.select(*out, "rank").union(rows.where(~wins).select(*out, F.lit(None).cast("long").alias("rank")))


#: The contract in DuckDB SQL. The CRC runs byte by byte over the distinct words.
SQL = """
WITH RECURSIVE t AS MATERIALIZED (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) r(i)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
dw AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
bw AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM b) GROUP BY w),
u AS MATERIALIZED (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
crc(w, x, pos, c) AS (
  SELECT w, x, 0, 4294967295::BIGINT FROM u
  UNION ALL
  SELECT w, x, pos + 1, xor(c >> 8, t.v)
  FROM crc JOIN t ON t.i = xor(c, ('0x' || substring(x, 2 * pos + 1, 2))::BIGINT) & 255
  WHERE 2 * pos < length(x)),
h AS MATERIALIZED (SELECT w, xor(c, 4294967295) % 10000 AS k FROM crc WHERE 2 * pos = length(x)),
s AS (SELECT k, sum(n) AS n FROM dw JOIN h USING (w) GROUP BY k),
g AS (SELECT k, sum(n) AS n FROM bw JOIN h USING (w) GROUP BY k),
tot AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS sn, coalesce((SELECT sum(n) FROM g), 0) AS tn),
gain AS MATERIALIZED (SELECT s.k, floor(1000 * ln((coalesce(g.n, 0) + 1)::DOUBLE * (sn + 10000)::DOUBLE
  / ((s.n + 1)::DOUBLE * (tn + 10000)::DOUBLE)))::BIGINT AS v FROM s LEFT JOIN g USING (k), tot),
wt AS (SELECT r, sum(n * v)::BIGINT AS weight FROM dw JOIN h USING (w) JOIN gain USING (k) GROUP BY r),
sc AS (SELECT d.r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
  (('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN wt ON d.r = wt.r),
fit AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, count(*) OVER () AS n
  FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM sc LEFT JOIN fit ON sc.r = fit.r
"""
