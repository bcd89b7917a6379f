"""Structured needs: the trie, the slots and their conflicts."""

import random

import pytest

from salesmatch.operators import needs

TURNS = "session_id long, turn int, role string, content string"


def slots(spark, *texts):
    rows = [(1, i, "user", t) for i, t in enumerate(texts)]
    return needs.structured_needs(spark.createDataFrame(rows, TURNS), "session_id", "turn", "content").first()


def brute(text, phrases=needs.PHRASES):
    """(pos, length, slot, value, numbers): the longest phrase of each place, none inside another one."""
    import re
    words = re.findall(needs._TOKEN, (text or "").lower())
    found = []
    for i in range(len(words)):
        best = None
        for p in phrases:
            t = needs.tokens_of(p.text)
            own = words[i:i + len(t)]
            if len(own) == len(t) and all(a == b or a == needs.NUMBER and b[0].isdigit() for a, b in zip(t, own)):
                if best is None or len(t) > best[1]:
                    best = (i, len(t), p.slot, p.value, [b for a, b in zip(t, own) if a == needs.NUMBER])
        if best:
            found.append(best)
    return [f for k, f in enumerate(found) if all(f[0] + f[1] > e[0] + e[1] for e in found[:k])]


def test_mentions_match_brute_force(spark):
    rnd = random.Random(5)
    pool = [t for p in needs.PHRASES for t in p.text.replace("<num>", "12").split()] + ["3", "2,500", "x", "の", "。", "-"]
    texts = [" ".join(rnd.choices(pool, k=rnd.randint(0, 40))) for _ in range(60)] + [None, "", "minivan " * 3000]
    rows = [(i, 0, "user", t) for i, t in enumerate(texts)]
    got = {}
    for r in needs.mentions(spark.createDataFrame(rows, TURNS), "session_id", "turn", "content").collect():
        got.setdefault(r.session_id, []).append((r.pos, r.length, r.slot, r.value, list(r.numbers)))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == brute(t), t


def test_dialogue_of_a_growing_family(spark):
    r = slots(spark, "今の車が手狭になってきて。家族4人で、週末は出かけることが多いです。", "妻も運転するので、大きすぎると怖いと言っていて。",
              "できれば２００万円台で収めたいですが、300万円くらいまでは考えます。", "自動ブレーキは絶対欲しいです。燃費も気になります。")
    assert (r.body_type, r.budget_min, r.budget_max, r.family_size, r.primary_use, r.sentiment) == (
        "minivan", 2_000_000, 3_000_000, 4, "leisure", "high")
    assert r.must_have_features == ["auto brake", "low fuel use"]
    assert r.concerns == ["hard to drive if too large"]


@pytest.mark.parametrize("text,low,high", [
    ("up to 3,000,000 yen", None, 3_000_000), ("from 150万円 to 250 thousand yen", 250_000, 1_500_000),
    ("between 1.5 and 2.5 million yen", 1_500_000, 2_500_000), ("300万円台", 3_000_000, 3_999_999),
    ("about 90 thousand yen", None, 90_000), ("200万円から300万円まで", 2_000_000, 3_000_000),
    ("200万円以上", 2_000_000, None), ("nothing about money, 300 times", None, None), ("250万円台。400万円まで", 2_500_000, 4_000_000)])
def test_budgets_have_one_unit(spark, text, low, high):
    r = slots(spark, text)
    assert (r.budget_min, r.budget_max) == (low, high)


def test_conflicts(spark):
    r = slots(spark, "A sedan up to 2 million yen with sliding doors, no diesel", "rather an SUV, at most 3 million yen",
              "no sliding doors! We are a family of 3, no, a family of 5")
    assert (r.body_type, r.budget_max, r.family_size) == ("suv", 3_000_000, 5)
    assert r.must_have_features == [] and r.deal_breakers == ["diesel", "sliding doors"]
    assert slots(spark, "station wagon").body_type == "wagon" and slots(spark, "wagons").body_type is None


def test_sessions_without_needs_and_repeated_turns(spark):
    rows = [(1, 0, "user", None), (2, 0, "user", ""), (3, 0, "user", "a suv"), (3, 0, "user", "a suv"), (None, 0, "user", "a sedan")]
    got = {r.session_id: r.body_type for r in needs.structured_needs(
        spark.createDataFrame(rows, TURNS), "session_id", "turn", "content").collect()}
    assert got == {1: None, 2: None, 3: "suv", None: None}
    empty = spark.createDataFrame([], TURNS)
    assert needs.structured_needs(empty, "session_id", "turn", "content").count() == 0


def test_the_trie_walk_shuffles_no_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "a suv")], TURNS)
    plan = needs.mentions(df, "session_id", "turn", "content")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "NestedLoop" not in plan


def test_customers_of_one_file_are_dealt_to_several_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from salesmatch.plans import q_needs

    rows = spark.range(0, 300, 1, 1).select(F.col("id").alias("c_custkey"), (F.col("id") * 7.5).alias("c_acctbal"))
    rows.union(rows.limit(1)).union(rows.limit(1).select(F.lit(None).cast("long"), F.lit(None).cast("double"))).coalesce(1).write.parquet(
        f"{tmp_path}/customer.parquet")
    whole = q_needs.dialogue(spark, str(tmp_path))
    assert whole.select(F.spark_partition_id()).distinct().count() == 1
    monkeypatch.setattr(q_needs, "CUSTOMERS_PER_TASK", 50)
    dealt = q_needs.dialogue(spark, str(tmp_path))
    each = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(each) == 7 and max(each) < 2 * min(each)
    assert dealt.exceptAll(whole).count() == whole.exceptAll(dealt).count() == 0
