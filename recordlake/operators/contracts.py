"""Contracts of tables as data, compiled to one plan that returns what breaks them.

A constraint names a table, the column that tells a row (`key`), the column it is about and its kind:
required (not null and not blank), unique, reference (`target` is table.column), enum (`values`), pattern (`values` has one regular
expression for the whole text), max_length (`values` has the number), members (each item of a list is one of `values`).
Null values only break `required`.

Values that have to meet are dealt out to as many tasks as their number asks for, so that a task's memory is bounded, whatever
the session's number of partitions: Spark joins or counts a partition's values in one task. For that, rows are counted first,
which for Parquet files reads no more than their footers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Values that one task joins or counts.
PER_TASK = 1_000_000


@dataclass(frozen=True)
class Constraint:
    table: str
    key: str
    column: str
    kind: str
    values: tuple[str, ...] = ()
    target: str = ""

    @property
    def name(self) -> str:
        return f"{self.table}.{self.column} {self.kind}"


def _broken(c: Constraint, x: Column) -> tuple[Column, Column]:
    """Whether a row breaks a constraint that it can be told by alone, and the value to show."""
    text = x.cast("string")
    if c.kind == "required":
        return x.isNull() | (F.trim(text) == ""), text
    if c.kind == "enum":
        return ~text.isin(*c.values), text
    if c.kind == "pattern":
        return ~text.rlike(f"^(?:{c.values[0]})$"), text
    if c.kind == "max_length":
        return F.length(text) > int(c.values[0]), F.concat(F.length(text).cast("string"), F.lit(" characters"))
    if c.kind == "members":
        odd = F.array_except(x, F.array(*map(F.lit, c.values)))
        return F.size(odd) > 0, F.array_join(odd, ",")
    raise ValueError(f"unknown kind of constraint: {c.kind}")


def _dealt(values: DataFrame, by: str, rows: int) -> DataFrame:
    """The values dealt out by one column; those of few rows by Spark itself."""
    own = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return values.repartition(max(own, -(-rows // PER_TASK)), by) if rows > PER_TASK else values


def _violations(tables: dict[str, DataFrame], c: Constraint) -> DataFrame:
    rows, x = tables[c.table], F.col(c.column)
    told = lambda df, key, value: df.select(F.lit(c.name).alias("constraint"), key.cast("string").alias("key"), value.alias("value"))
    if c.kind == "unique":
        own = _dealt(rows.select(x.alias("v")).where("v is not null"), "v", rows.count())
        found = own.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return told(found, F.col("v"), F.concat(F.col("n").cast("string"), F.lit(" rows")))
    if c.kind == "reference":
        table, column = c.target.split(".")
        known = tables[table].select(F.col(column).alias("__known")).where("__known is not null")
        own = rows.where(x.isNotNull()).select(F.col(c.key).alias("__key"), x.alias("__value"))
        n = max(rows.count(), tables[table].count())
        # Hashed, as the rows that refer need no sort then; the target's values are held once each.
        held = _dealt(known, "__known", n)
        held = held.hint("shuffle_hash") if n > PER_TASK else held
        found = _dealt(own, "__value", n).join(held, F.col("__value") == F.col("__known"), "left_anti")
        return told(found, F.col("__key"), F.col("__value").cast("string"))
    bad, value = _broken(c, x)
    return told(rows.where(bad), F.col(c.key), value)


def violations(tables: dict[str, DataFrame], constraints: list[Constraint]) -> DataFrame:
    """constraint, key, value of every breach, by one plan over all tables."""
    return reduce(DataFrame.unionByName, (_violations(tables, c) for c in constraints))


def require(tables: dict[str, DataFrame], constraints: list[Constraint], shown: int = 20) -> None:
    """An error that shows some of the breaches, if there are any."""
    found = violations(tables, constraints).limit(shown).collect()
    if found:
        raise ValueError("contract broken: " + "; ".join(f"{r.constraint}: {r.key} has {r.value}" for r in found))
