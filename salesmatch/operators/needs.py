"""Structured needs from conversation turns.

Phrases of a fixed dictionary fill typed slots: body type, family size, budget,
must-haves, use, brands, deal breakers, concerns, sentiment. The dictionary is a
trie of tokens, given as a small edge table. Turns are exploded into token
positions, each with the few tokens that follow; one broadcast join for each level
of the trie walks all positions at once and keeps the longest phrase. ``<num>``
stands for any number, whose value the phrase captures. No text is shuffled: only
matched phrases go to the fold by key.

Conflicts: a phrase inside a longer one does not count; of a single-valued slot the
last mention (turn, then place) holds; a must-have that is a deal breaker as well
is none; a lower budget above the upper one changes places with it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBER = "<num>"
# One token: a number, a kana or Han character, or a run of Latin letters.
_TOKEN = r"[0-9]+(?:[,.][0-9]+)*|[぀-ヿ㐀-鿿]|[a-zß-ɏ]+"
_PYTHON_TOKEN = re.compile(f"{NUMBER}|{_TOKEN}")
_WIDE_DIGITS = "０１２３４５６７８９"


@dataclass(frozen=True)
class Phrase:
    """``text`` fills ``slot`` with ``value``; in budget slots the value is the unit of the numbers in yen."""

    slot: str
    value: str
    text: str


# Our own dictionary. Slots of many values are lists, the others hold one value.
VALUES = {
    "body_type": {
        "minivan": ["minivan", "ミニバン", "手狭"], "suv": ["suv", "sport utility"], "sedan": ["sedan", "セダン"],
        "wagon": ["station wagon", "wagon", "ワゴン"], "compact": ["compact car", "compact", "コンパクトカー"],
        "pickup": ["pickup", "pickup truck", "トラック"]},
    "family_size": {"": ["family of <num>", "<num> of us", "<num>人家族", "家族<num>人", "<num> people"]},
    "primary_use": {
        "leisure": ["weekend trips", "leisure", "家族で出かける", "週末"], "commuting": ["commute", "commuting", "通勤"],
        "business": ["business", "仕事"]},
    "must_have_features": {
        "auto brake": ["automatic brakes", "auto brake", "自動ブレーキ"], "low fuel use": ["low fuel use", "good mileage", "燃費"],
        "sliding doors": ["sliding doors", "スライドドア"]},
    "preferred_brands": {"toyota": ["toyota", "トヨタ"], "honda": ["honda", "ホンダ"], "lexus": ["lexus", "レクサス"]},
    "deal_breakers": {
        "two doors": ["no two doors", "ツードアは嫌"], "diesel": ["no diesel", "ディーゼルは嫌"],
        "sliding doors": ["no sliding doors", "スライドドアは嫌"]},
    "concerns": {"hard to drive if too large": ["too large", "too big", "大きすぎる"], "price": ["too expensive", "高すぎる"]},
    "sentiment": {"high": ["very soon", "絶対欲しい"], "low": ["just looking", "見るだけ"]},
}
UNITS = {"yen": 1, "円": 1, "thousand yen": 1_000, "万円": 10_000, "million yen": 1_000_000}
BUDGETS = {
    "budget_max": ["up to <num> {u}", "at most <num> {u}", "<num>{u}まで", "<num>{u}くらいまで", "to <num> {u}"],
    "budget_min": ["from <num> {u}", "at least <num> {u}", "<num>{u}から", "<num>{u}以上"],
    "budget_both": ["between <num> and <num> {u}"],
    "budget_band": ["<num>{u}台", "<num> {u} range"],
    "budget_about": ["<num> {u}"],
}
LISTS = ("must_have_features", "preferred_brands", "deal_breakers", "concerns")
PHRASES = [Phrase(slot, value, text) for slot, values in VALUES.items() for value, texts in values.items() for text in texts] + [
    Phrase(slot, str(factor), text.format(u=unit)) for slot, texts in BUDGETS.items() for text in texts
    for unit, factor in UNITS.items()]


def tokens_of(phrase: str) -> list[str]:
    return _PYTHON_TOKEN.findall(phrase.lower())


def trie_edges(phrases: list[Phrase]) -> tuple[list[tuple[int, str, int, str | None, str | None]], int]:
    """(node, token, next, slot, value) of the trie's edges from node 0, and the longest phrase's tokens. An edge
    that ends a phrase names its slot and value; of phrases with equal tokens the first counts."""
    children: dict[tuple[int, str], int] = {}
    ends: dict[int, Phrase] = {}
    longest = 0
    for p in phrases:
        tokens, node = tokens_of(p.text), 0
        if not tokens or any(t[0].isdigit() for t in tokens):
            raise ValueError(f"a phrase needs tokens, and {NUMBER} for numbers: {p}")
        longest = max(longest, len(tokens))
        for t in tokens:
            node = children.setdefault((node, t), len(children) + 1)
        ends.setdefault(node, p)
    return [(a, t, b, ends[b].slot if b in ends else None, ends[b].value if b in ends else None)
            for (a, t), b in children.items()], longest


def tokens(text: Column) -> Column:
    """Lower-case tokens of a text; digits of full width count as digits. A null text has none."""
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), _WIDE_DIGITS, "0123456789")
    return F.regexp_extract_all(low, F.lit(_TOKEN), F.lit(0))


def mentions(turns: DataFrame, key: str, order: str, text: str, phrases: list[Phrase] | None = None) -> DataFrame:
    """key, order, pos, length, slot, value and numbers of every phrase found, without those inside a longer one.

    Rows that share key and order are told apart by their text."""
    edges, longest = trie_edges(phrases or PHRASES)
    spark = turns.sparkSession
    edge = F.broadcast(spark.createDataFrame(edges, "_node int, _token string, _next int, _slot string, _value string"))
    places = turns.select(
        F.col(key).alias("_key"), F.col(order).alias("_order"), F.xxhash64(text).alias("_row"), tokens(F.col(text)).alias("_tokens")
    ).where(F.size("_tokens") > 0).select("_key", "_order", "_row", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size("_tokens")), lambda i: F.slice(F.col("_tokens"), i, longest))).alias("pos", "_w"))
    state = places.withColumn("_at", F.lit(0)).withColumn("_best", F.lit(None).cast(
        "struct<length:int,slot:string,value:string,numbers:array<string>>")).withColumn(
        "_numbers", F.array().cast("array<string>"))
    for depth in range(longest):
        token = F.get("_w", F.lit(depth))
        is_number = F.coalesce(token.rlike("^[0-9]"), F.lit(False))
        step = state.withColumn("_t", F.when(is_number, F.lit(NUMBER)).otherwise(token))
        step = step.join(edge, (F.col("_at") == F.col("_node")) & (F.col("_t") == F.col("_token")), "left" if depth else "inner")
        step = step.withColumn("_numbers", F.when(is_number & F.col("_next").isNotNull(), F.concat("_numbers", F.array(token)))
                               .otherwise(F.col("_numbers")))
        found = F.struct(F.lit(depth + 1).alias("length"), F.col("_slot").alias("slot"), F.col("_value").alias("value"),
                         F.col("_numbers").alias("numbers"))
        state = step.withColumn("_best", F.when(F.col("_slot").isNotNull(), found).otherwise(F.col("_best"))).withColumn(
            "_at", F.col("_next")).drop("_t", "_node", "_token", "_next", "_slot", "_value")
    hits = state.where("_best is not null").select("_key", "_order", "_row", "pos", "_best.*")
    before = Window.partitionBy("_key", "_order", "_row").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("length")
    kept = hits.withColumn("_covered", F.max(end).over(before)).where(F.col("_covered").isNull() | (F.col("_covered") < end))
    return kept.select(F.col("_key").alias(key), F.col("_order").alias(order), "pos", "length", "slot", "value", "numbers")


def _amount(i: int) -> Column:
    number = F.regexp_replace(F.get("numbers", F.lit(i)), ",", "").try_cast("double")
    return F.round(number * F.col("value").try_cast("double")).cast("long")


def structured_needs(turns: DataFrame, key: str, order: str, text: str, phrases: list[Phrase] | None = None) -> DataFrame:
    """One row for each key of ``turns``: the slots as typed columns, null (or an empty list) where nothing was said.

    ``budget_band`` is a range of the amount's leading digit (2 million range: 2,000,000 to 2,999,999); its upper end
    gives way to a stated upper budget. An amount without a side is an upper budget if none is stated."""
    m = mentions(turns, key, order, text, phrases)
    when = F.struct(F.col(order), F.col("pos"))
    first, second = _amount(0), _amount(1)
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(first, F.lit(1)).cast("double")) + 1e-9)).cast("long")

    def last(slot: str, value: Column, *others: tuple[str, Column]) -> Column:
        case = F.when(F.col("slot") == slot, value)
        for name, v in others:
            case = case.when(F.col("slot") == name, v)
        return F.max_by(case, F.when(case.isNotNull(), when))

    def values(slot: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("slot") == slot, F.col("value"))))  # at most the dictionary's

    slots = m.groupBy(key).agg(
        last("body_type", F.col("value")).alias("body_type"),
        last("family_size", F.regexp_replace(F.get("numbers", F.lit(0)), ",", "").try_cast("int")).alias("family_size"),
        last("primary_use", F.col("value")).alias("primary_use"), last("sentiment", F.col("value")).alias("sentiment"),
        last("budget_max", first, ("budget_both", second)).alias("_max"),
        last("budget_min", first, ("budget_both", first)).alias("_min"),
        last("budget_band", first).alias("_low"), last("budget_band", first + unit - 1).alias("_high"),
        last("budget_about", first).alias("_about"), *[values(s).alias(s) for s in LISTS])
    low, high = F.coalesce("_min", "_low"), F.coalesce("_max", "_high", "_about")
    slots = slots.select(
        key, "body_type", F.when(low > high, high).otherwise(low).alias("budget_min"),
        F.when(low > high, low).otherwise(high).alias("budget_max"), "family_size", "primary_use",
        F.array_except("must_have_features", "deal_breakers").alias("must_have_features"), "preferred_brands", "deal_breakers",
        "concerns", "sentiment")
    none = F.array().cast("array<string>")
    return turns.select(key).distinct().join(slots, key, "left").select(
        key, "body_type", "budget_min", "budget_max", "family_size", "primary_use", "sentiment",
        *[F.coalesce(s, none).alias(s) for s in LISTS])
