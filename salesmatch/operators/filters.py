"""Projections, filters, search and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmatch.functions.text import contains_ci

# Fixed value from the reference: the largest page size.
MAX_PAGE = 100


def lookup(df: DataFrame, key: str, keys: DataFrame | list) -> DataFrame:
    """Rows whose key is in ``keys`` (a DataFrame of keys -> semi join; a
    short Python list -> ``isin``, pushed into the scan)."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(F.col(keys.columns[0]).alias(key)), key, "left_semi")
    return df.where(F.col(key).isin(list(keys)))


def optional_filter(df: DataFrame, body_type: str | None = None, min_price=None,
                    max_price=None, price: str = "price", body: str = "body_type") -> DataFrame:
    """Conjunctive filters where None, '' and 0 all mean "no filter"."""
    conds: list[Column] = []
    if body_type:
        conds.append(F.col(body) == F.lit(body_type))
    if min_price:
        conds.append(F.col(price) >= F.lit(min_price))
    if max_price:
        conds.append(F.col(price) <= F.lit(max_price))
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def search_literal(df: DataFrame, term: str | None, cols: list[str]) -> DataFrame:
    """Case-insensitive literal search over ``cols`` (OR); '%' and '_'
    are ordinary characters; null columns never match."""
    if not term:
        return df
    return df.where(reduce(lambda a, b: a | b, [contains_ci(c, term) for c in cols]))


def search_like(df: DataFrame, term: str | None, cols: list[str]) -> DataFrame:
    """Case-sensitive ``LIKE '%term%'``; '%' and '_' in ``term`` stay
    wildcards, as in the reference's database mode."""
    if not term:
        return df
    pattern = f"%{term}%"
    return df.where(reduce(lambda a, b: a | b,
                           [F.coalesce(F.col(c).like(pattern), F.lit(False)) for c in cols]))


def alias_missing(df: DataFrame, target: str, source: str) -> DataFrame:
    """``target`` := ``source`` when ``target`` is absent or null."""
    if target in df.columns:
        return df.withColumn(target, F.coalesce(F.col(target), F.col(source)))
    return df.withColumn(target, F.col(source))


def alias_missing_in_array(df: DataFrame, array_col: str, struct_field: str, target: str,
                           source: str) -> DataFrame:
    """P9 inside arrays: for every element's ``struct_field`` struct, set
    ``target`` to ``source`` when ``target`` is absent or null."""
    has_target = target in _fields(df, array_col, struct_field)

    def fix(x):
        inner = x[struct_field]
        value = F.coalesce(inner[target], inner[source]) if has_target else inner[source]
        return x.withField(struct_field, inner.withField(target, value))
    return df.withColumn(array_col, F.transform(F.col(array_col), fix))


def _fields(df: DataFrame, array_col: str, struct_field: str) -> list[str]:
    elem = df.schema[array_col].dataType.elementType
    return elem[struct_field].dataType.fieldNames()


def lookup_param(df: DataFrame, key: str, value) -> DataFrame:
    """Key lookup through a parameterized SQL statement: the value is a
    bound parameter, never spliced into the SQL text (no quote doubling)."""
    spark = df.sparkSession
    return spark.sql(f"SELECT * FROM {{src}} WHERE `{key}` = :value", args={"value": value}, src=df)


def without_system(df: DataFrame, role: str = "role") -> DataFrame:
    """Drop system turns."""
    return df.where(F.col(role) != "system")


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """O3: one page in a total key order (trap T7: add the primary key to
    ``order``). Planned as a top-(offset+limit) sort, no full sort."""
    if not 0 < limit <= MAX_PAGE:
        raise ValueError(f"limit must be in 1..{MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must be >= 0")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, key: str, after, limit: int = 50, descending: bool = False) -> DataFrame:
    """O3, deep paging: the next ``limit`` rows after key value ``after``
    (seek method; the predicate reaches the scan, cost independent of depth)."""
    c = F.col(key)
    if after is not None:
        df = df.where(c < F.lit(after) if descending else c > F.lit(after))
    return df.orderBy(c.desc() if descending else c.asc()).limit(limit)
