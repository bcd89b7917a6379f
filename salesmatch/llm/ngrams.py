"""A modified Kneser-Ney model of character n-grams, counted by Spark.

The unit is the character: word n-grams of a corpus are mostly unique, and
counting them would shuffle more than the corpus itself. A text is lower-cased,
its white space runs become one space, and it is framed by newlines. Languages
have models of their own.

A task counts the distinct n-grams of bounded pieces of text; Spark sums them and
derives continuation counts, discounts, interpolated probabilities and back-off
weights with aggregates and joins. For scoring, the model becomes two sorted
arrays, of hashes and of values. They are broadcast after a check of their size;
a larger model is joined with the distinct n-grams of blocks of texts instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmatch.llm import packing
from salesmatch.llm.common import arrow_batches, text_or_empty, tidy, written
from salesmatch.llm.wordblocks import _distinct

ORDER = 5
#: Characters counted at once by a task; longer texts are taken in overlapping windows. Scoring holds the
#: model beside them and takes fewer at once.
WINDOW, SCORE_WINDOW = 2 << 20, 1 << 18
#: Distinct n-grams sent at once; rows and bytes of texts that go to Python at once.
SENT, BATCH = 1 << 17, (1000, 4 << 20)
#: Largest model, as hash and value arrays (16 bytes an entry), that is broadcast.
BROADCAST_BYTES = 128 << 20
#: Most languages whose discounts or bands are broadcast; more are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000
_B = np.uint64(0x9E3779B97F4A7C15)


def stream(text: str) -> np.ndarray:
    """Code points of the framed text; U+0000 becomes U+FFFD."""
    s = "\n" * (ORDER - 1) + " ".join(text.lower().split()) + "\n"
    if "\0" in s:
        s = s.replace("\0", "�")
    return np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32)


def seed(lang: str, kind: int) -> np.uint64:
    """Start of a hash; kind is the order of an n-gram, or 16 more for a back-off context."""
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), kind))


def gram_hash(points: np.ndarray, at: np.ndarray, size: int, start: np.ndarray | np.uint64) -> np.ndarray:
    """Hashes of the ``size`` code points from each place of ``at``."""
    h = np.full(len(at), start, np.uint64) if np.isscalar(start) else start.copy()
    for k in range(size):
        h = (h + points[at + k].astype(np.uint64) + np.uint64(1)) * _B
        h ^= h >> np.uint64(31)
    return h


def pieces(rows, window: int = WINDOW):
    """Bounded groups of (number, language, code points) from rows of (number, language, text)."""
    group, size = [], 0
    for number, lang, text in rows:
        points = stream(text)
        for at in range(0, len(points) - ORDER + 1, window):
            part = points[at:at + window + ORDER - 1]
            group.append((number, lang, part))
            size += len(part)
            if size >= window:
                yield group
                group, size = [], 0
    if group:
        yield group


def _joined(group):
    points = np.concatenate([p for _, _, p in group])
    n = np.array([len(p) for _, _, p in group], np.int64)
    begin = np.cumsum(n) - n
    own = n - ORDER + 1
    at = np.arange(own.sum()) + np.repeat(begin - (np.cumsum(own) - own), own)
    return points, at, own


def distinct_grams(group):
    """Of a group: (language number and place of each distinct n-gram, number of each n-gram, n-grams of each text)."""
    points, at, own = _joined(group)
    langs = sorted({lang for _, lang, _ in group})
    number = {lang: i for i, lang in enumerate(langs)}
    lang_of = np.repeat(np.array([number[lang] for _, lang, _ in group]), own)
    starts = np.array([seed(lang, ORDER) for lang in langs], np.uint64)
    # The hash of gram_hash for every place of the joined points, by whole columns.
    sizes = [len(p) for _, _, p in group]
    wide = points.astype(np.uint64) + np.uint64(1)
    last = len(wide) - ORDER + 1
    h = np.repeat(starts[[number[lang] for _, lang, _ in group]], sizes)[:last]
    for k in range(ORDER):
        h += wide[k:last + k]
        h *= _B
        h ^= h >> np.uint64(31)
    h = h[at]
    found = _distinct(h, h)
    head, index = found if found is not None else np.unique(h, return_index=True, return_inverse=True)[1:]
    return points, langs, lang_of[head], at[head], h[head], index, own


def count_grams(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """lang, gram, n: how often each n-gram stands in the documents of a language."""

    def run(batches):
        for b in batches:
            rows = zip(range(b.num_rows), b.column(0).to_pylist(), b.column(1).to_pylist())
            for group in pieces(rows):
                points, langs, of, at, _, index, _ = distinct_grams(group)
                n, names = np.bincount(index, minlength=len(at)), np.array(langs, object)
                del index
                for k in range(0, len(at), SENT):
                    grams = points[at[k:k + SENT, None] + np.arange(ORDER)].view(f"<U{ORDER}").ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[of[k:k + SENT]], pa.string()), pa.array(grams.tolist(), pa.string()),
                         pa.array(n[k:k + SENT])], ["lang", "gram", "n"])

    rows = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(tidy(run), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("c"))


@dataclass
class Model:
    """rows: lang, k, gram, logp of every n-gram up to ORDER; backoff: lang, k, gram, logg of every context of order k."""

    rows: DataFrame
    backoff: DataFrame


def fit(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Count all documents and estimate the model. A null language is one of its own; null texts count as empty."""
    with arrow_batches(docs.sparkSession, *BATCH):
        grams = {ORDER: written(count_grams(docs, lang, text), "grams")}
    for k in range(ORDER - 1, 0, -1):
        grams[k] = written(grams[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(
            F.count("*").alias("c")), "grams")
    # A few numbers for each language; they are broadcast after a check of their number.
    small = grams[1].select("lang").distinct().limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    n = [F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    rows, backoff = None, None
    for k in range(1, ORDER + 1):
        few = grams[k].groupBy("lang").agg(*n, F.count("*").alias("types"))
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

        def discount(i):
            d = F.lit(float(i)) - F.try_divide((i + 1) * y * F.col(f"n{i + 1}"), F.col(f"n{i}"))
            ok = (F.col(f"n{i}") > 0) & (F.col("n1") > 0) & d.between(0.01 * i, float(i))
            return F.when(ok, d).otherwise(F.lit(0.5 * i)).alias(f"d{i}")

        table = written(few.select("lang", "types", *[discount(i) for i in (1, 2, 3)]), "discounts")
        table = F.broadcast(table) if small else table
        own = grams[k].join(table, "lang").withColumn(
            "d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))) \
            .withColumn("context", F.substring("gram", 1, k - 1))
        weight = own.groupBy("lang", "context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("g"))
        full = own.join(weight, ["lang", "context"])
        own_part = (F.col("c") - F.col("d")) / F.col("total")
        if k == 1:
            level = full.select("lang", "gram", (own_part + F.col("g") / (F.col("types") + 1)).alias("p"))
        else:
            lower = level.select("lang", F.col("gram").alias("tail"), F.col("p").alias("q"))
            level = full.withColumn("tail", F.substring("gram", 2, k - 1)).join(lower, ["lang", "tail"]).select(
                "lang", "gram", (own_part + F.col("g") * F.col("q")).alias("p"))
        level = written(level, "level")
        logs = level.select("lang", F.lit(k).alias("k"), "gram", F.log("p").alias("logp"))
        out = weight.select("lang", F.lit(k).alias("k"), F.col("context").alias("gram"), F.log("g").alias("logg"))
        if k == 1:  # an unknown character gets the unigrams' back-off, spread evenly
            out = weight.join(few, "lang").select("lang", F.lit(1).alias("k"), F.lit("").alias("gram"),
                                                  F.log(F.col("g") / (F.col("types") + 1)).alias("logg"))
        out = written(out, "backoff")
        rows, backoff = (logs, out) if rows is None else (rows.union(logs), backoff.union(out))
    return Model(rows, backoff)


class HashedModel:
    """The model as sorted hash arrays."""

    def __init__(self, model: Model):
        def run(batches):
            for b in batches:
                langs, kinds = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy()
                grams = np.array(b.column(2).to_pylist(), object)
                h = np.empty(b.num_rows, np.uint64)
                for kind in np.unique(kinds).tolist():  # all n-grams of a kind have one length
                    own = np.flatnonzero(kinds == kind)
                    size = kind if kind < 16 else kind - 17
                    names, of = np.unique(langs[own].astype(str), return_inverse=True)
                    starts = np.array([seed(str(x), kind) for x in names], np.uint64)
                    points = np.frombuffer("".join(grams[own]).encode("utf-32-le"), np.uint32)
                    h[own] = gram_hash(points, np.arange(len(own)) * size, size, starts[of])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), b.column(3)], ["h", "v"])

        both = model.rows.select("lang", "k", "gram", "logp").union(
            model.backoff.select("lang", F.col("k") + 16, "gram", "logg"))
        got = both.mapInArrow(run, "h long, v double").toArrow()
        h = got.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        self.hashes = h[order]
        del h
        self.values = got.column("v").to_numpy()[order]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return self.hashes[at] == h, self.values[at]

    def logp(self, points, langs, of, at, h) -> np.ndarray:
        """Natural log probability of each n-gram at a place of ``points``, backing off where it is unknown."""
        out = np.zeros(len(at))
        todo = np.arange(len(at))
        for k in range(ORDER, 0, -1):
            skip = ORDER - k
            if k < ORDER:
                starts = np.array([seed(x, k) for x in langs], np.uint64)
                h = gram_hash(points, at[todo] + skip, k, starts[of[todo]])
            known, value = self.find(h)
            out[todo[known]] += value[known]
            todo = todo[~known]
            if not len(todo):
                break
            starts = np.array([seed(x, 16 + k) for x in langs], np.uint64)
            known, value = self.find(gram_hash(points, at[todo] + skip, k - 1, starts[of[todo]]))
            out[todo] += np.where(known, value, -20.0 if k == 1 else 0.0)
        return out


def model_bytes(model: Model) -> int:
    return 16 * (model.rows.count() + model.backoff.count())


_GRAM, _TEXT = 0, 1


def _blocks(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """Texts cut into blocks of bounded size, as one table of two kinds of rows: each distinct n-gram of a block once,
    with its place in the block, and each piece of a text as the places and counts of its distinct n-grams."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            keys, seen = b.column(2).to_pylist(), set()
            for group in pieces(zip(range(b.num_rows), b.column(0).to_pylist(), b.column(1).to_pylist())):
                points, langs, of, at, _, index, own = distinct_grams(group)
                number += 1
                names = np.array(langs, object)
                for k in range(0, len(at), SENT):
                    grams = points[at[k:k + SENT, None] + np.arange(ORDER)].view(f"<U{ORDER}").ravel().tolist()
                    n = len(grams)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([_GRAM] * n, pa.int32()), pa.array([number] * n, pa.int64()), pa.array(names[of[k:k + SENT]], pa.string()),
                         pa.array(grams, pa.string()), pa.array(np.arange(k, k + n)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()),
                         pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=fields)
                edge, out = np.cumsum(own) - own, []
                for (i, name, _), begin, size in zip(group, edge.tolist(), own.tolist()):
                    places, n = np.unique(index[begin:begin + size], return_counts=True)
                    out.append((_TEXT, number, name, None, None, keys[i], int(i not in seen), packing.pack_rising(places), packing.pack_ints(n)))
                    seen.add(i)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)

    fields = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("lang", pa.string()), ("gram", pa.string()), ("place", pa.int64()),
                        ("row", pa.int64()), ("first", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])
    body = text_or_empty(text)
    rows = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), body.alias("text"), F.xxhash64(body).alias("row"))
    return rows.mapInArrow(tidy(run), "kind int, block long, lang string, gram string, place long, row long, first int, "
                                      "places binary, counts binary")


def _backed_off(grams: DataFrame, model: Model) -> DataFrame:
    """lang, gram and logp of n-grams that the model does not know as such, through its lower orders."""
    total, missing = F.lit(0.0), F.lit(True)
    for k in range(ORDER, 0, -1):
        tail = F.substring("gram", ORDER - k + 1, k)
        head = F.substring("gram", ORDER - k + 1, k - 1)
        p = model.rows.where(F.col("k") == k).select("lang", F.col("gram").alias("t"), F.col("logp").alias(f"p{k}"))
        g = model.backoff.where(F.col("k") == k).select("lang", F.col("gram").alias("t"), F.col("logg").alias(f"g{k}"))
        grams = grams.withColumn("t", tail).join(p, ["lang", "t"], "left").drop("t")
        grams = grams.withColumn("t", head).join(g, ["lang", "t"], "left").drop("t")
        total = total + F.when(missing, F.coalesce(f"p{k}", f"g{k}", F.lit(-20.0 if k == 1 else 0.0))).otherwise(0.0)
        missing = missing & F.col(f"p{k}").isNull()
    return grams.select("lang", "gram", total.alias("logp"))


def joined_scores(docs: DataFrame, model: Model, lang: str, text: str) -> DataFrame:
    """lang, row (hash of the text), n_grams and logp of every distinct text: the way for a model too large to broadcast.

    No text is shuffled. Each distinct n-gram of a block of texts meets the model's highest order in one join, and
    the values go back to the block by one more shuffle. Only n-grams that the model does not know take the way through
    its lower orders, each distinct one once; of texts that the model was fitted on there are none.
    """
    blocks = written(_blocks(docs, lang, text), "ngram_blocks", partition_by="kind")
    grams = blocks.where(F.col("kind") == _GRAM).select("block", "lang", "gram", "place")
    texts = blocks.where(F.col("kind") == _TEXT).select("block", "lang", "row", "first", "places", "counts")
    known = model.rows.where(F.col("k") == ORDER).select("lang", "gram", "logp")
    met = written(grams.join(known, ["lang", "gram"], "left"), "ngram_values")
    new = written(met.where("logp is null").select("lang", "gram").distinct(), "ngram_unknown")
    if new.limit(1).count():
        back = _backed_off(new, model).withColumnRenamed("logp", "lower")
        met = met.join(back, ["lang", "gram"], "left").select("block", "place", F.coalesce("logp", "lower").alias("logp"))

    def put_back(left: pa.Table, right: pa.Table) -> pa.Table:
        value = np.zeros(right.num_rows)
        value[right.column("place").to_numpy()] = right.column("logp").to_numpy()
        n, total = [], []
        for places, counts in zip(left.column("places").to_pylist(), left.column("counts").to_pylist()):
            count = packing.unpack_ints(counts).astype(np.int64)
            n.append(int(count.sum()))
            total.append(float((value[packing.unpack_rising(places)] * count).sum()))
        return pa.table([left.column("lang"), left.column("row"), left.column("first"), pa.array(n, pa.int64()), pa.array(total, pa.float64())],
                        ["lang", "row", "first", "n", "logp"])

    parts = texts.groupBy("block").cogroup(met.select("block", "place", "logp").groupBy("block")).applyInArrow(
        put_back, "lang string, row long, first int, n long, logp double")
    # Copies of a text add up alike; their number is that of the first pieces.
    return parts.groupBy("lang", "row").agg(
        (F.sum("n") / F.sum("first")).cast("long").alias("n_grams"), (F.sum("logp") / F.sum("first")).alias("logp"))
