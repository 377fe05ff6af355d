"""Select: access order, paging, then sorting of that page, then projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.conditions import Conditions, access_rank, fold
from lodestone.schema import Schema
from lodestone.scratch import numbered

#: The hidden row number. Names that begin so belong to the engine: no table can have them.
SEQ = "_seq"
#: Pages that end within so many rows are taken by a top-k of narrow state; beyond, rows are numbered in sorted order.
TOP = 100_000


@dataclass
class Query:
    """What a select, update or delete says about rows; ``limit`` -1 is all."""

    where: Conditions | None = None
    begin: int = 0
    limit: int = -1
    order: tuple[str, bool] | None = None
    columns: str | None = "*"


def projection(schema: Schema, columns: str | None) -> list[str]:
    """``*`` is all columns in order; otherwise names between commas, repeats kept; blank is no column."""
    if columns is None:
        raise ValueError("a column list is missing")
    if columns.strip() == "*":
        return schema.names
    wanted = [c.strip() for c in columns.split(",")] if columns.strip() else []
    for c in wanted:
        schema[c]  # raises for an unknown column, whether or not rows match
    return wanted


def _columns(schema: Schema) -> dict[str, Column]:
    return {c: F.col(c) for c in schema.names}


def matching(df: DataFrame, schema: Schema, where: Conditions | None) -> DataFrame:
    if where is None:
        return df
    for _, p in where.items:
        schema[p.column]
    return df.where(fold(where.items, _columns(schema), schema.types, True))


def access_keys(schema: Schema, where: Conditions | None) -> list[Column]:
    """Sort keys of the order in which rows are met: that of the condition's column if it is indexed, else arrival."""
    if where is None:
        first = schema.preferred
        return ([F.col(first.name).asc_nulls_first()] if first else []) + [F.col(SEQ).asc()]
    rank = access_rank(where.items, _columns(schema), schema.types)
    single = len(where.items) == 1 or all(clause == "AND" for clause, _ in where.items[1:])
    keys: list[Column] = [] if single else [rank.asc()]
    brings = [0] if single else [k for k, (clause, _) in enumerate(where.items) if k == 0 or clause == "OR"]
    for k in brings:
        p = where.items[k][1]
        if schema[p.column].indexed:
            c = F.col(p.column)
            keys.append((c if single else F.when(rank == k, c)).asc_nulls_first())
    return [*keys, F.col(SEQ).asc()]


def page(df: DataFrame, schema: Schema, q: Query) -> DataFrame:
    """The rows of a query with their hidden number; offset and limit follow the access order.

    No plan brings more than TOP rows into one task. A far page is cut by numbers that the rows get in sorted
    order, range by range, in a table of the scratch folder that is written when the plan is made.
    """
    rows = matching(df, schema, q.where)
    begin, end = max(q.begin, 0), max(q.begin, 0) + q.limit if q.limit >= 0 else None
    if q.limit == 0:
        return rows.limit(0)
    if begin == 0 and end is None:
        return rows
    ordered = rows.orderBy(*access_keys(schema, q.where))
    if end is None and begin <= TOP:
        return rows.join(ordered.limit(begin).select(SEQ), SEQ, "left_anti").select(*df.columns)
    if end is not None and end <= TOP:
        return (ordered.offset(begin) if begin else ordered).limit(q.limit)
    at = numbered(ordered, "_seq_at")
    at = at.where(F.col("_seq_at") >= begin)
    return (at if end is None else at.where(F.col("_seq_at") < end)).select(*df.columns)


def select(df: DataFrame, schema: Schema, q: Query, ordered: bool = False) -> DataFrame:
    """Paging comes before sorting: ASC and DEC order only the page. Unsorted unless an order is asked for or ``ordered``."""
    names = projection(schema, q.columns)
    rows = page(df, schema, q)
    if q.order:
        schema[q.order[0]]
        c = F.col(q.order[0])
        rows = rows.orderBy(c.asc_nulls_first() if q.order[1] else c.desc_nulls_last(), *access_keys(schema, q.where))
    elif ordered:
        rows = rows.orderBy(*access_keys(schema, q.where))
    return rows.select(*names)
