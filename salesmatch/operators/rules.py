"""Data rules as data (Q1-Q4, J7, Q7): one plan for each table, metrics of the writing job.

A table's rules are a list. ``report`` compiles all of them to one pass: references
are looked up by joins with the parents' distinct keys, row rules become counts, and
keys are counted by one aggregate in which every rule of uniqueness has its own
groups; the table is scanned once. ``checked_write`` applies the row rules while a
table is written: the counts come from ``DataFrame.observe``, so no row is read
twice, and rejected rows keep the names of the rules they break.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NotNull:
    column: str

    @property
    def name(self) -> str:
        return f"{self.column} not null"

    def broken(self) -> Column:
        return F.col(self.column).isNull()


@dataclass(frozen=True)
class Holds:
    """``condition`` (SQL text) must be true; null counts as broken."""

    name: str
    condition: str

    def broken(self) -> Column:
        return ~F.coalesce(F.expr(self.condition), F.lit(False))


@dataclass(frozen=True)
class Unique:
    columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{', '.join(self.columns)} unique"


@dataclass(frozen=True)
class References:
    """A non-null ``column`` must be one of ``parent.key``."""

    column: str
    parent: str
    key: str

    @property
    def name(self) -> str:
        return f"{self.column} in {self.parent}"


Rule = NotNull | Holds | Unique | References


def report(df: DataFrame, table: str, rules: list[Rule], parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """table_name, rule, n_rows and n_violations, a row for each rule.

    A violation is a row; of a key that stands n times in a ``Unique`` rule all n rows are. Keys with a null in
    them are compared like others. The table is read once; each parent's key column once.
    """
    flags, rows = {}, df
    for i, r in enumerate(rules):
        if isinstance(r, References):
            keys = parents[r.parent].select(F.col(r.key).alias(f"_p{i}")).where(f"_p{i} is not null").distinct()
            rows = rows.join(keys, F.col(r.column) == F.col(f"_p{i}"), "left")
            flags[i] = F.col(r.column).isNotNull() & F.col(f"_p{i}").isNull()
        elif not isinstance(r, Unique):
            flags[i] = r.broken()
    unique = {i: r for i, r in enumerate(rules) if isinstance(r, Unique)}
    counts = [F.count_if(F.col("_first") & f).alias(f"_r{i}") for i, f in flags.items()]
    total = F.count_if("_first").alias("_rows")
    if unique:
        # A row once for each key rule, and one more time where there are flags to count; the key is its JSON text.
        group = F.explode(F.array(*[F.struct(F.lit(i).alias("u"), F.to_json(F.struct(*r.columns), {"ignoreNullFields": "false"}).alias("key"))
                                    for i, r in unique.items()]))
        first = min(unique)
        flagged = rows.select(*[f.alias(f"_f{i}") for i, f in flags.items()], group.alias("_g")).withColumn(
            "_first", F.col("_g.u") == first)
        counts = [F.count_if(F.col("_first") & F.col(f"_f{i}")).alias(f"_r{i}") for i in flags]
        per_key = flagged.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), total, *counts)
        done = per_key.agg(F.sum("_rows").alias("_rows"), *[F.sum(f"_r{i}").alias(f"_r{i}") for i in flags], *[
            F.sum(F.when((F.col("_g.u") == i) & (F.col("_n") > 1), F.col("_n"))).alias(f"_r{i}") for i in unique])
    else:
        done = rows.withColumn("_first", F.lit(True)).agg(total, *counts)
    out = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.coalesce(F.col(f"_r{i}"), F.lit(0)).cast("long").alias("n"))
                              for i, r in enumerate(rules)]))
    return done.select(F.lit(table).alias("table_name"), F.coalesce("_rows", F.lit(0)).cast("long").alias("n_rows"), out.alias("o")).select(
        "table_name", "o.rule", "n_rows", F.col("o.n").alias("n_violations"))


def report_all(tables: dict[str, tuple[DataFrame, list[Rule]]], parents: dict[str, DataFrame] | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, [report(df, name, rules, parents) for name, (df, rules) in tables.items()])


def checked_write(df: DataFrame, rules: list[NotNull | Holds], path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Q7: write ``df`` to the new folder ``path`` in one job; returns (accepted, rejected, counts).

    Rejected rows have ``broken``, the names of their broken rules in the rules' order. ``counts`` holds ``rows``,
    ``rejected`` and the violations of every rule, observed while writing."""
    if any(not isinstance(r, (NotNull, Holds)) for r in rules):
        raise ValueError("keys and references need the whole table: use report")
    broken = F.filter(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    marked = df.withColumn("broken", broken).withColumn("outcome", F.when(F.size("broken") == 0, "accepted").otherwise("rejected"))
    seen = Observation()
    marked = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("broken") > 0).alias("rejected"),
                            *[F.count_if(F.array_contains("broken", r.name)).alias(r.name) for r in rules])
    marked.write.partitionBy("outcome").parquet(path)
    back = df.sparkSession.read.schema(marked.schema).parquet(path)
    return (back.where("outcome = 'accepted'").drop("outcome", "broken"), back.where("outcome = 'rejected'").drop("outcome"), dict(seen.get))
