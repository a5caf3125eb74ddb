"""Declared constraints on tables, checked in one pass over each: what a database would refuse, as rows that name the violations.

A table's rows are turned into facts (a failed check, a key that must be unique, a reference, a key that can be referred to), and one
aggregation over the facts of all tables finds the violations. Partial sums make a hot key one row a task.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A condition that holds or is null for every row."""

    name: str
    table: str
    condition: str


@dataclass(frozen=True)
class Unique:
    """At most one row with the same values of columns among those that meet where (one default a project, say); nulls never clash."""

    name: str
    table: str
    columns: tuple[str, ...]
    where: str = "true"


@dataclass(frozen=True)
class Reference:
    """A column, where not null, is the key of a row of another table that meets where (a selected config that is active and global, say)."""

    name: str
    table: str
    column: str
    to: str
    key: str
    where: str = "true"


def _value(columns: Iterable[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)]))


def _facts(rows: DataFrame, table: str, constraints: list) -> DataFrame | None:
    """constraint, value, and what the row is for it: refers (a row that needs a target), target, bad (a failed check)."""
    out = []

    def fact(name: str, value: Column, condition: Column, **marks: int) -> None:
        kinds = [F.lit(marks.get(k, 0)).alias(k) for k in ("bad", "keys", "refers", "targets")]
        out.append(F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(name).alias("constraint"), value.alias("value"), *kinds)))

    for c in constraints:
        if isinstance(c, Check) and c.table == table:
            fact(c.name, F.lit(None).cast("string"), ~F.expr(c.condition), bad=1)
        elif isinstance(c, Unique) and c.table == table:
            whole = reduce(lambda a, b: a & b, (F.col(x).isNotNull() for x in c.columns))
            fact(c.name, _value(c.columns), whole & F.expr(c.where), keys=1)
        elif isinstance(c, Reference):
            if c.table == table:
                fact(c.name, _value([c.column]), F.col(c.column).isNotNull(), refers=1)
            if c.to == table:
                fact(c.name, _value([c.key]), F.col(c.key).isNotNull() & F.expr(c.where), targets=1)
    return rows.select(F.explode(F.array_compact(F.array(*out))).alias("f")).select("f.*") if out else None


def violations(tables: dict[str, DataFrame], constraints: list) -> DataFrame:
    """constraint, value (JSON of the key or reference; null for checks) and rows: how many rows break a constraint, by value.

    Keys and references of different integer widths are compared as numbers are written in JSON. Without constraints, an error.
    """
    facts = [f for name, rows in tables.items() if (f := _facts(rows, name, constraints)) is not None]
    total = reduce(DataFrame.unionByName, facts).groupBy("constraint", "value").agg(*[F.sum(c).alias(c) for c in ("bad", "keys", "refers", "targets")])
    rows = F.col("bad") + F.when(F.col("keys") > 1, F.col("keys")).otherwise(0) + F.when(F.col("targets") == 0, F.col("refers")).otherwise(0)
    return total.select("constraint", "value", rows.alias("rows")).where("rows > 0")
