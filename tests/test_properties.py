"""Property checks (hypothesis): round trips and invariants."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmatch.functions import jsonparse
from salesmatch.operators import metrics, ranking

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.tuples(st.integers(-10**12, 10**12), st.text(max_size=12)), min_size=1, max_size=8),
       st.sampled_from(["{}", "Sure: {} ok", "```json\n{}\n```", "```\n{}\n```"]))
def test_parse_of_format_is_identity(spark, items, wrapper):
    texts = [wrapper.replace("{}", json.dumps({"a": a, "b": b}, ensure_ascii=False)) for a, b in items]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    ok, parsed = jsonparse.parse_fenced_braced("text", SCHEMA)
    got = [(r.ok, r.p.a, r.p.b) for r in df.select(ok.alias("ok"), parsed.alias("p")).collect()]
    assert got == [(True, a, b) for a, b in items]


@SETTINGS
@given(st.lists(st.integers(0, 6), max_size=40))
def test_rating_distribution_sums_to_in_range_count(spark, ratings):
    df = spark.createDataFrame([(r, None) for r in ratings], "rating int, ground_truth string")
    r = metrics.rating_summary(df).first()
    assert r.total_evaluations == len(ratings)
    assert sum(r[f"rating_{k}"] for k in (1, 2, 3, 4, 5)) == sum(1 for x in ratings if 1 <= x <= 5)


@SETTINGS
@given(st.integers(1, 95), st.integers(2, 12))
def test_down_sample_keeps_first_and_last(spark, n, every):
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    idx = [r[0] for r in ranking.down_sample(df, ["k"], "t", every).orderBy("t").select("point_index").collect()]
    assert idx[0] == 0 and idx[-1] == n - 1
    assert set(idx) == {i for i in range(n) if i % every == 0} | {n - 1}
