"""Data rules in one pass, and metrics of the writing job."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from salesmatch.operators import rules as R

ROW = "k long, owner long, score int, broken string"
SF = "/root/testdata/sf0.001"


def test_every_kind_of_rule(spark):
    rows = [(1, 10, 5, "a"), (1, 11, None, "a"), (2, None, 101, None), (3, 99, -1, "b"), (None, 10, 7, "c"), (None, 10, 7, "c")]
    df = spark.createDataFrame(rows, ROW)
    parent = spark.createDataFrame([(10,), (10,), (11,), (None,)], "id long")
    rules = [R.NotNull("k"), R.Unique(("k",)), R.Unique(("k", "owner", "score")), R.References("owner", "owners", "id"),
             R.Holds("score 0 to 100", "score between 0 and 100"), R.NotNull("broken")]
    got = {r.rule: (r.n_rows, r.n_violations) for r in R.report(df, "t", rules, {"owners": parent}).collect()}
    assert got == {"k not null": (6, 2), "k unique": (6, 4), "k, owner, score unique": (6, 2), "owner in owners": (6, 1),
                   "score 0 to 100": (6, 3), "broken not null": (6, 1)}
    only_rows = {r.rule: r.n_violations for r in R.report(df, "t", [R.NotNull("k"), R.Holds("x", "score > 6")]).collect()}
    assert only_rows == {"k not null": 2, "x": 3}
    nothing = R.report(df.where("false"), "t", rules, {"owners": parent}).collect()
    assert len(nothing) == 6 and all((r.n_rows, r.n_violations) == (0, 0) for r in nothing)


def test_a_table_is_scanned_once(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("owner"), F.lit(1).alias("score"), F.lit("x").alias("broken"))
    df.write.parquet(str(tmp_path / "t"))
    rules = [R.NotNull("k"), R.Unique(("k",)), R.Unique(("owner",)), R.Holds("s", "score > 0")]
    plan = R.report(spark.read.parquet(str(tmp_path / "t")), "t", rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_every_rule_is_broken_in_the_registered_report(spark):
    assert all(r.n_violations > 0 for r in E.queries()["rule_report"](spark, "/root/testdata/sf0.01").collect())
    got = E.queries()["checked_intake"](spark, SF).collect()
    assert {r.outcome for r in got} == {"accepted", "rejected"} and {r.broken for r in got} >= {"", "feedback not null", "rating 1 to 5"}
    assert sum(r.n_records for r in got) == got[0].observed_rows
    assert sum(r.n_records for r in got if r.outcome == "rejected") == got[0].observed_rejected > 0


def test_checked_write_counts_while_writing(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 5, "x"), (None, 1, 500, "y"), (2, 1, None, "z")], "k long, owner long, score int, note string")
    good, bad, seen = R.checked_write(df, [R.NotNull("k"), R.Holds("score small", "score < 100")], str(tmp_path / "w"))
    assert seen == {"rows": 3, "rejected": 2, "k not null": 1, "score small": 2}
    assert [r.k for r in good.collect()] == [1] and good.columns == df.columns
    assert {r.note: r.broken for r in bad.collect()} == {"y": ["k not null", "score small"], "z": ["score small"]}
    with pytest.raises(ValueError):
        R.checked_write(df, [R.Unique(("k",))], str(tmp_path / "x"))
