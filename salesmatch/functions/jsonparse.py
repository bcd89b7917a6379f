"""Model-response text -> typed rows (X3, X4), with Python's strictness.

Spark's JSON readers stop after the first value, ignore what follows and by
default take single quotes; Python's ``json.loads`` rejects both. Here the text
``x`` is parsed once, as the array ``[x, {"<end mark>": true}]`` with strict
options: it is exactly one value only if the array has two elements and the
second is the end mark. Raw control characters, comments, single quotes, trailing
prose, a second object and a text that closes the array early all fail. NaN and
Infinity are accepted, as by ``json.loads``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmatch.functions.text import strip_ws

FENCE = "```"
JSON_FENCE = "```json"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def brace_cut(col) -> Column:
    """From the first '{' to the last '}' (greedy, dot matches newline); '' if none."""
    return F.regexp_extract(_c(col), r"(?s)\{.*\}", 0)


def fence_cut(col) -> Column:
    """Text inside the first ```json fence, else inside the first bare fence,
    else the whole text (up to the next fence, as ``split(...)[1].split(...)[0]``)."""
    c = _c(col)
    inner_json = F.split_part(F.split_part(c, F.lit(JSON_FENCE), F.lit(2)), F.lit(FENCE), F.lit(1))
    inner_bare = F.split_part(c, F.lit(FENCE), F.lit(2))
    return (F.when(F.contains(c, F.lit(JSON_FENCE)), inner_json)
            .when(F.contains(c, F.lit(FENCE)), inner_bare)
            .otherwise(c))


# Never the name of a field of a reply.
_END = "\u0002end"
_STRICT = {"allowSingleQuotes": "false", "allowComments": "false", "allowUnquotedControlChars": "false",
           "allowUnquotedFieldNames": "false", "mode": "PERMISSIVE"}


def _pair(c: Column, schema: T.StructType) -> Column:
    """The text and the end mark as an array of structs; null if it is no JSON."""
    kind = T.ArrayType(T.StructType([*schema.fields, T.StructField(_END, T.BooleanType())]))
    return F.from_json(F.concat(F.lit("["), c, F.lit(',{"\\u0002end":true}]')), kind, _STRICT)


def _one_object(c: Column, pair: Column) -> Column:
    return F.coalesce(c.startswith("{") & (F.size(pair) == 2) & F.get(pair, 1)[_END], F.lit(False))


def _struct(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _first(pair: Column, schema: T.StructType) -> Column:
    value = F.get(pair, 0)
    return F.struct(*[value[f.name].alias(f.name) for f in schema.fields])


def single_object(col) -> Column:
    """True when the text is exactly one JSON object (Python ``json.loads`` accepts it)."""
    return strict_object(col, T.StructType([]))[0]


def strict_object(col, schema: T.StructType | str) -> tuple[Column, Column]:
    """(ok, struct): ok when the stripped text is exactly one JSON object."""
    c, schema = strip_ws(_c(col)), _struct(schema)
    pair = _pair(c, schema)
    ok = _one_object(c, pair)
    return ok, F.when(ok, _first(pair, schema)) if schema.fields else F.lit(None)


def parse_brace(col, schema) -> tuple[Column, Column]:
    """Brace cut then strict parse -> (ok, struct)."""
    return strict_object(brace_cut(col), schema)


def parse_fenced_braced(col, schema) -> tuple[Column, Column]:
    """X4 (recommendation variant): fence cut, then brace cut, then strict parse."""
    return strict_object(brace_cut(fence_cut(col)), schema)


def parse_fenced(col, schema) -> tuple[Column, Column]:
    """X4 (insight variant): fence cut, whitespace strip, strict parse; no brace cut."""
    return strict_object(fence_cut(col), schema)


CUTS = {
    "brace": brace_cut,
    "fenced_braced": lambda c: brace_cut(fence_cut(c)),
    "fenced": fence_cut,
}


def with_parsed(df: DataFrame, text: str, schema, variant: str, ok_col: str = "ok",
                out_col: str = "parsed") -> DataFrame:
    """DataFrame form of the parsers. Adds ``ok_col`` and ``out_col``."""
    return with_parses(df, text, schema, [(variant, ok_col, out_col)])


def with_parses(df: DataFrame, text: str, schema, parses: list[tuple[str, str, str]]) -> DataFrame:
    """Several cuts of one text, as (variant, ok_col, out_col): each cut and each parsed pair is a column of its own,
    computed once a row, and a cut that equals an earlier one takes its pair without a second parse."""
    schema, staged, gone, done = _struct(schema), df, [], []
    for variant, ok_col, out_col in parses:
        cut, pair = f"_{out_col}_cut", f"_{out_col}_pair"
        staged = staged.withColumn(cut, strip_ws(CUTS[variant](F.col(text))))
        parsed = _pair(F.col(cut), schema)
        for earlier in reversed(done):
            parsed = F.when(F.col(cut) == F.col(f"_{earlier}_cut"), F.col(f"_{earlier}_pair")).otherwise(parsed)
        staged = staged.withColumn(pair, parsed)
        staged = staged.withColumn(ok_col, _one_object(F.col(cut), F.col(pair)))
        staged = staged.withColumn(out_col, F.when(F.col(ok_col), _first(F.col(pair), schema)))
        gone += [cut, pair]
        done.append(out_col)
    return staged.drop(*gone)


#: Why a reply was rejected, in the order of the tests.
REASONS = ("empty", "not_object", "not_strict", "broken")


def with_outcome(df: DataFrame, text: str, schema, variant: str, out_col: str = "parsed") -> DataFrame:
    """Adds ``out_col`` and ``reason``: null for a good reply, else the first that applies of ``empty`` (the cut finds
    nothing), ``not_object`` (it does not begin an object), ``not_strict`` (a lenient reader takes its first value, but
    text or a second value follows or the notation is no JSON), ``broken`` (no reader takes it)."""
    cut, pair, schema = f"_{out_col}_cut", f"_{out_col}_pair", _struct(schema)
    staged = df.withColumn(cut, F.coalesce(strip_ws(CUTS[variant](F.col(text))), F.lit("")))
    staged = staged.withColumn(pair, _pair(F.col(cut), schema))
    ok = _one_object(F.col(cut), F.col(pair))
    reason = (F.when(ok, F.lit(None).cast("string")).when(F.col(cut) == "", "empty")
              .when(~F.col(cut).startswith("{"), "not_object")
              .when(F.get_json_object(cut, "$").isNotNull(), "not_strict").otherwise("broken"))
    staged = staged.withColumn("reason", reason)
    return staged.withColumn(out_col, F.when(F.col("reason").isNull(), _first(F.col(pair), schema))).drop(cut, pair)


def route(df: DataFrame, text: str, schema, variant: str, path: str, out_col: str = "parsed") -> tuple[DataFrame, DataFrame]:
    """Parse every reply once into the new folder ``path`` and return (good, rejects), read from its two parts.

    Good rows have ``out_col`` and lose ``text``; rejects keep ``text`` and have their ``reason``. The replies are
    evaluated by the one writing job: an expensive or unrepeatable source is not asked again for the rejects."""
    done = with_outcome(df, text, schema, variant, out_col)
    done = done.withColumn("outcome", F.when(F.col("reason").isNull(), "good").otherwise("reject"))
    done = done.withColumn(text, F.when(F.col("reason").isNotNull(), F.col(text)))
    done.write.partitionBy("outcome").parquet(path)
    kind = T.StructType([*(f for f in done.schema.fields if f.name != "outcome"), T.StructField("outcome", T.StringType())])
    back = df.sparkSession.read.schema(kind).parquet(path)
    return (back.where("outcome = 'good'").drop("outcome", "reason", text),
            back.where("outcome = 'reject'").drop("outcome", out_col))


def record(value: dict, schema: T.StructType) -> Column:
    """A constant struct of ``schema`` (texts and lists of texts)."""
    return F.struct(*[F.lit(value.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])
