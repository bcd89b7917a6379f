"""Request templates (X1): a declared list of lines becomes one text column.

A template is data: each line names a column, its label, what stands for a missing
value, how a list is joined and where a text is cut. ``compile_template`` turns it
into one expression of built-in functions, so a request is a projection of its row
and nothing is collected or looped over. A line with a ``missing`` text is there
for every row; one without it (``missing=None``) goes when its value is null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Line:
    """``label`` + value + ``tail``. Numbers get thousands separators; ``cut`` keeps the first characters."""

    label: str
    column: str | None = None
    missing: str | None = "-"
    sep: str = ", "
    cut: int | None = None
    tail: str = ""


@dataclass(frozen=True)
class Ranked:
    """The first ``most`` structs of an array column, one line each; ``parts`` are texts and field names in turn."""

    column: str
    parts: tuple[str, ...]
    most: int
    numbered: str = "{n}. "
    missing: str | None = "-"


@dataclass(frozen=True)
class Template:
    name: str
    system: str
    lines: tuple[Line | Ranked, ...]


def _text(schema: T.StructType, name: str, sep: str, column: Column) -> Column:
    """The value as text, null where there is nothing to say: null, an empty text or an empty list."""
    kind = schema[name].dataType
    if isinstance(kind, T.ArrayType):
        items = F.filter(column, lambda x: x.isNotNull() & (x.cast("string") != ""))
        return F.nullif(F.array_join(F.transform(items, lambda x: x.cast("string")), sep), F.lit(""))
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        return F.format_number(column, 0)
    return F.nullif(column.cast("string"), F.lit(""))


def _line(line: Line, schema: T.StructType) -> Column:
    if line.column is None:
        return F.lit(line.label)
    value = _text(schema, line.column, line.sep, F.col(line.column))
    if line.cut is not None:
        value = F.substring(value, 1, line.cut)
    if line.missing is not None:
        value = F.coalesce(value, F.lit(line.missing))
    return F.concat(F.lit(line.label), value, F.lit(line.tail))


def _ranked(r: Ranked, schema: T.StructType) -> Column:
    item = schema[r.column].dataType.elementType

    def one(x: Column, i: Column) -> Column:
        before, after = r.numbered.split("{n}")
        place = F.concat(F.lit(before), (i + 1).cast("string"), F.lit(after))
        body = [F.lit(p) if k % 2 == 0 else F.coalesce(_text(item, p, ", ", x[p]), F.lit("-")) for k, p in enumerate(r.parts)]
        return F.concat(place, *body)

    lines = F.nullif(F.array_join(F.transform(F.slice(r.column, 1, r.most), one), "\n"), F.lit(""))
    return lines if r.missing is None else F.coalesce(lines, F.lit(r.missing))


def compile_template(template: Template, schema: T.StructType) -> Column:
    """The request text of a row; its lines are joined by line ends."""
    return F.concat_ws("\n", *[_ranked(x, schema) if isinstance(x, Ranked) else _line(x, schema) for x in template.lines])


def requests_of(rows: DataFrame, template: Template, key: str) -> DataFrame:
    """key, template, system and request of every row."""
    return rows.select(key, F.lit(template.name).alias("template"), F.lit(template.system).alias("system"),
                       compile_template(template, rows.schema).alias("request"))
