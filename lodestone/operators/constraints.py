"""Rows that break a rule, as DataFrames; a statement looks at all of its rules in one action."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.errors import CheckConstraintError, EntryValidationError, ForeignKeyError
from lodestone.plans.conditions import fold
from lodestone.schema import ForeignKey, Schema


def null_violations(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def size_violations(df: DataFrame, column: str, size: int) -> DataFrame:
    return df.where(F.length(column) > size)


def duplicate_keys(df: DataFrame, column: str) -> DataFrame:
    """(column, count) of values that occur more than once; nulls are exempt."""
    found = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_seq_n")).where("_seq_n > 1")
    return found.toDF(column, "count")


def check_violations(df: DataFrame, schema: Schema, name: str) -> DataFrame:
    columns = {c: F.col(c) for c in schema.names}
    return df.where(~fold(schema.checks[name].items, columns, schema.types, False))


def orphans(child: DataFrame, parent: DataFrame, key: ForeignKey) -> DataFrame:
    """Rows whose key is nowhere in the parent, as a whole; a key with a null is exempt."""
    some = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in key.columns))
    keys = parent.select(*(F.col(p).alias(f"_seq_p{i}") for i, p in enumerate(key.parent_columns)))
    on = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_seq_p{i}") for i, c in enumerate(key.columns)))
    return child.where(some).join(keys, on, "left_anti")


def referencing(child: DataFrame, keys: DataFrame, key: ForeignKey, how: str = "left_semi") -> DataFrame:
    """Rows of the child whose key is among the parent rows ``keys``; with left_anti the others."""
    its = keys.select(*(F.col(p).alias(f"_seq_p{i}") for i, p in enumerate(key.parent_columns)))
    on = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_seq_p{i}") for i, c in enumerate(key.columns)))
    return child.join(its, on, how)


def validate(schema: Schema, rows: DataFrame, whole: DataFrame, parents: dict[str, DataFrame]) -> None:
    """Raise for the first rule that ``rows`` breaks, in the order null, size, unique, checks, foreign keys.

    ``whole`` is the table as it would be, with the rows in it; uniqueness holds for that final state.
    """
    found: list[tuple[str, str, DataFrame]] = []
    for c in schema.columns:
        if c.required:
            found.append(("null", c.name, null_violations(rows, c.name)))
        if c.type.sized:
            found.append(("size", c.name, size_violations(rows, c.name, c.size)))
    for c in schema.columns:
        if c.primary or c.unique:
            own = rows.where(F.col(c.name).isNotNull()).select(c.name).distinct()
            found.append(("unique", c.name, duplicate_keys(whole.join(own, c.name, "left_semi"), c.name)))
    found += [("check", name, check_violations(rows, schema, name)) for name in schema.checks]
    found += [("foreign", k.name, orphans(rows, parents[k.parent], k)) for k in schema.foreign_keys]
    if not found:
        return
    marks = [df.select(F.lit(i).alias("i")).limit(1) for i, (_, _, df) in enumerate(found)]
    first = reduce(DataFrame.unionAll, marks).agg(F.min("i").alias("i")).first()["i"]
    if first is not None:
        kind, name, _ = found[first]
        if kind == "check":
            raise CheckConstraintError(name)
        if kind == "foreign":
            raise ForeignKeyError(name, "names a key that does not exist")
        raise EntryValidationError({"null": f"{name} is null", "size": f"{name} is too long", "unique": f"{name} is not unique"}[kind])
