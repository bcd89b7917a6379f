"""Operator 8: quality rules with an n-gram perplexity band for each language.

Base rules count words, symbols, repeated lines and repeated three-word windows.
A modified Kneser-Ney model (``ngrams``) is fitted on all documents; a document's
score is its log perplexity per word that holds a letter, so that separators and
other marks add to it and do not thin it out. A language's band reaches some
quartile distances beyond the quartiles of its distinct scores. Copies share a
score and count once, so a large group of copies does not narrow the band.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmatch.llm import ngrams
from salesmatch.llm.common import ASCII_WS, arrow_batches, give_back, text_or_empty, tidy, written

#: Quartile distances from the quartiles to the lower and upper end of a language's band, and the least
#: distance taken. Rule for both ends: the labelled clean document furthest out on that side (3.81 down and
#: 3.53 up on sf0.1), rounded up to a half.
BELOW, ABOVE, LEAST = 4.0, 4.0, 0.2
MIN_WORDS, MAX_REPEAT = 50, 50
SYMBOLS = "#*$%&|<>"
#: From the first letter of a word to the word's end.
_LETTER_WORD = re.compile(rf"[^\W\d_][^{ASCII_WS}]*").findall
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    data = text.encode()
    words = data.split()
    chars = len(text) - sum(text.count(c) for c in ASCII_WS)
    symbols = sum(data.count(c.encode()) for c in SYMBOLS)
    seen, dup = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeat = 0
    if len(words) > 3:
        ids: dict[bytes, int] = {}
        w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
        pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
        _, at, n = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        often = n[at] > 1
        held = np.zeros(len(words), bool)
        for k in range(3):
            held[k:len(words) - 2 + k] |= often
        repeat = int(held.sum())
    return len(words), chars, symbols, dup, repeat


def features(docs: DataFrame, key: list[str], lang: str, text: str, model: ngrams.HashedModel | None,
             carry: bool = False) -> DataFrame:
    """``key`` columns, lang, row (hash of the text), the five counts, n_letter_words, and n_grams and logp if a
    model is given; with ``carry`` the text itself too, so that a caller needs no second copy of it in ``key``."""
    spark = docs.sparkSession
    names = [f"_k{i}" for i in range(len(key))]
    passed = [*names, "_lang", "_row", *(["_text"] if carry else [])]
    shared = spark.sparkContext.broadcast(model) if model is not None else None

    def run(batches):
        for b in batches:
            langs, texts = b.column("_lang").to_pylist(), b.column("_text").to_pylist()
            counts = list(zip(*(text_counts(t) for t in texts))) or [()] * 5
            logp, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            if shared is not None:
                for group in ngrams.pieces(zip(range(len(texts)), langs, texts), ngrams.SCORE_WINDOW):
                    points, names_, of, at, h, index, own = ngrams.distinct_grams(group)
                    value = shared.value.logp(points, names_, of, at, h)[index]
                    rows = np.array([i for i, _, _ in group])
                    np.add.at(logp, rows, np.add.reduceat(value, np.cumsum(own) - own))
                    np.add.at(n, rows, own)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in passed), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([len(_LETTER_WORD(t)) for t in texts], pa.int64()), pa.array(n), pa.array(logp)],
                [*passed, *_COUNTS, "n_letter_words", "n_grams", "logp"])

    body = text_or_empty(text)
    rows = docs.select(*[F.col(k).alias(c) for k, c in zip(key, names)], F.coalesce(F.col(lang), F.lit("")).alias("_lang"),
                       F.xxhash64(body).alias("_row"), body.alias("_text"))
    out = rows.mapInArrow(tidy(run), T.StructType(
        [*(rows.schema[c] for c in passed), *(T.StructField(c, T.LongType()) for c in (*_COUNTS, "n_letter_words", "n_grams")),
         T.StructField("logp", T.DoubleType())]))
    return out.select(*[F.col(c).alias(k) for k, c in zip(key, names)], F.col("_lang").alias("model_lang"),
                      F.col("_row").alias("text_hash"), *([F.col("_text").alias(text)] if carry else []),
                      *_COUNTS, "n_letter_words", "n_grams", "logp")


def bands(scores: DataFrame, below: float = BELOW, above: float = ABOVE, least: float = LEAST) -> DataFrame:
    """model_lang, low, high: the band of scores that each language keeps."""
    q = scores.select("model_lang", "score").distinct().groupBy("model_lang").agg(
        F.percentile_approx("score", [0.25, 0.75], 10_000).alias("q"))
    width = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(least))
    return q.select("model_lang", (F.col("q")[0] - below * width).alias("low"),
                    (F.col("q")[1] + above * width).alias("high"))


def judge(docs: DataFrame, key: list[str], lang: str = "lang", text: str = "text",
          broadcast_bytes: int = ngrams.BROADCAST_BYTES, carry: bool = False) -> DataFrame:
    """``key`` columns, text_hash, the counts, score, base_failed and kept of every row; with ``carry`` the text too.

    A text fails the base rules with fewer than 50 words, or with over half of its
    words in repeated three-word windows. Otherwise it is kept if its score lies in
    its language's band; a text without any letter has no score and is not kept.
    A null text counts as empty, a null language as one of its
    own. Repeated rows get equal results; extra columns are ignored.
    """
    model = ngrams.fit(docs, lang, text)
    if ngrams.model_bytes(model) <= broadcast_bytes:
        rows = features(docs, key, lang, text, ngrams.HashedModel(model), carry)
        give_back()  # the driver too; the broadcast keeps the model in a file
    else:
        scored = ngrams.joined_scores(docs, model, lang, text).select(
            F.col("lang").alias("model_lang"), F.col("row").alias("text_hash"), "n_grams", "logp")
        rows = features(docs, key, lang, text, None, carry).drop("n_grams", "logp").join(scored, ["model_lang", "text_hash"])
    # Both forms of the model sum the same doubles in another order; rounding makes their scores equal.
    with arrow_batches(docs.sparkSession, *ngrams.BATCH):
        rows = written(rows.withColumn("score", F.round(F.try_divide(-F.col("logp"), F.col("n_letter_words")), 9)), "quality")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    band = written(bands(rows.where(~failed)), "bands")
    small = band.limit(ngrams.BROADCAST_LANGUAGES + 1).count() <= ngrams.BROADCAST_LANGUAGES
    return rows.join(F.broadcast(band) if small else band, "model_lang", "left").select(
        *key, "model_lang", "text_hash", *([text] if carry else []), *_COUNTS, "score", "low", "high", failed.alias("base_failed"),
        (~failed & F.coalesce(F.col("score").between(F.col("low"), F.col("high")), F.lit(False))).alias("kept"))


def verdicts(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept and the score."""
    return judge(docs, ["doc_id"]).select("doc_id", *_COUNTS, "base_failed", "kept", "score")
