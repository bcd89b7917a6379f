"""Strict response parsing (X3, X4, T15-T17) on hand-written texts.

Each case names the text, the cut that each variant should make, and nothing
else: whether a cut is one JSON object is asked of ``json.loads`` itself.
"""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmatch.functions import jsonparse

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
NONE = ""

# text, brace cut, fence cut, brace cut of the fence cut
CASES = [
    ('{"a": 1}', '{"a": 1}', '{"a": 1}', '{"a": 1}'),
    ('Here: {"a": 2, "b": "x"} bye', '{"a": 2, "b": "x"}', 'Here: {"a": 2, "b": "x"} bye', '{"a": 2, "b": "x"}'),
    ('{"a": 1} or {"a": 2}', '{"a": 1} or {"a": 2}', '{"a": 1} or {"a": 2}', '{"a": 1} or {"a": 2}'),
    ('{"a": 1}], [{"a": 2}', '{"a": 1}], [{"a": 2}', '{"a": 1}], [{"a": 2}', '{"a": 1}], [{"a": 2}'),
    ('{"a": 1', NONE, '{"a": 1', NONE),
    ("", NONE, "", NONE),
    ("nothing", NONE, "nothing", NONE),
    ('{"a": 3, "b": "}{"}', '{"a": 3, "b": "}{"}', '{"a": 3, "b": "}{"}', '{"a": 3, "b": "}{"}'),
    ('```json\n{"a": 5}\n```', '{"a": 5}', '\n{"a": 5}\n', '{"a": 5}'),
    ('```\n{"a": 6}\n``` later {', '{"a": 6}', '\n{"a": 6}\n', '{"a": 6}'),
    ('x ```json\n{"a": 7}', '{"a": 7}', '\n{"a": 7}', '{"a": 7}'),
    ('{"a": 8}\u3000', '{"a": 8}', '{"a": 8}\u3000', '{"a": 8}'),
    ("{'a': 1}", "{'a': 1}", "{'a': 1}", "{'a': 1}"),
    ('{"b": "x\ny"}', '{"b": "x\ny"}', '{"b": "x\ny"}', '{"b": "x\ny"}'),
    ('{"a": 1}/*c*/', '{"a": 1}', '{"a": 1}/*c*/', '{"a": 1}'),
    ('{"a": 1/*c*/}', '{"a": 1/*c*/}', '{"a": 1/*c*/}', '{"a": 1/*c*/}'),
    ('{a: 1}', '{a: 1}', '{a: 1}', '{a: 1}'),
    ('{"b": "\u5024"} \u5f8c', '{"b": "\u5024"}', '{"b": "\u5024"} \u5f8c', '{"b": "\u5024"}'),
    ('[1, 2]', NONE, '[1, 2]', NONE),
    ('{"a": 1},{}', '{"a": 1},{}', '{"a": 1},{}', '{"a": 1},{}'),
]


def one_object(cut):
    try:
        value = json.loads(cut.strip())
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


@pytest.mark.parametrize("column,cutter", [
    (1, jsonparse.brace_cut), (2, jsonparse.fence_cut), (3, lambda c: jsonparse.brace_cut(jsonparse.fence_cut(c)))])
def test_cuts(spark, column, cutter):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", cutter("t").alias("c")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[column] for c in CASES]


@pytest.mark.parametrize("variant,column,parser", [
    ("brace", 1, jsonparse.parse_brace), ("fenced", 2, jsonparse.parse_fenced),
    ("fenced_braced", 3, jsonparse.parse_fenced_braced)])
def test_one_object_as_json_loads_says(spark, variant, column, parser):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    ok, parsed = parser("t", SCHEMA)
    direct = {r.i: r for r in df.select("i", ok.alias("ok"), parsed.alias("parsed")).collect()}
    staged = {r.i: r for r in jsonparse.with_parsed(df, "t", SCHEMA, variant).collect()}
    for i, case in enumerate(CASES):
        expect = one_object(case[column])
        for row in (direct[i], staged[i]):
            assert row.ok == (expect is not None), case[0]
            if expect is not None:
                assert (row.parsed.a, row.parsed.b) == (expect.get("a"), expect.get("b")), case[0]
            else:
                assert row.parsed is None, case[0]


@pytest.mark.parametrize("text,brace,fenced", [
    ('{"a": 1}', None, None), ("", "empty", "empty"), (None, "empty", "empty"), ("no object", "empty", "not_object"),
    ('{"a": 1} {"a": 2}', "not_strict", "not_strict"), ('so {"a": 1} there', None, "not_object"), ('{"a": 1', "empty", "broken"),
    ('{"a": }', "broken", "broken"), ("{'a': 1}", "not_strict", "not_strict"), ('[{"a": 1}]', None, "not_object"),
    ('```json\n{"a": 1}\n```', None, None), ('```json\n{"a": 1}\nx\n```', None, "not_strict")])
def test_reasons_of_rejects(spark, text, brace, fenced):
    df = spark.createDataFrame([(text,)], "t string")
    for variant, want in (("brace", brace), ("fenced", fenced)):
        r = jsonparse.with_outcome(df, "t", "a int", variant).first()
        assert r.reason == want and (r.parsed is None) == (want is not None), variant


def test_replies_are_routed_by_one_job(spark, tmp_path):
    """The source is unrepeatable: only one evaluation can give parts that add up."""
    df = spark.range(400).select("id", F.when(F.rand() < 0.5, '{"a": 1}').otherwise("nothing").alias("t"))
    good, bad = jsonparse.route(df, "t", "a int", "brace", str(tmp_path / "r"))
    ids = [r.id for r in good.collect()] + [r.id for r in bad.collect()]
    assert sorted(ids) == list(range(400)) and good.count() + bad.count() == 400
    assert good.columns == ["id", "parsed"] and bad.columns == ["id", "t", "reason"]


def test_constant_record(spark):
    from salesmatch import schemas
    from salesmatch.plans.q_replies import DEFAULT_INSIGHT
    r = spark.range(1).select(jsonparse.record(DEFAULT_INSIGHT, schemas.INSIGHT).alias("r")).first().r
    assert r.asDict() == DEFAULT_INSIGHT
