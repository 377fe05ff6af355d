"""Update, delete and insert as post-images: pure functions from a table to the next one."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.arith import compile_arithmetic, names
from lodestone.operators.select import SEQ, Query, page
from lodestone.plans.conditions import Conditions, fold, holds, literal
from lodestone.schema import Schema

Fn = Callable[[Column], Column]
HIT = "_seq_hit"


class Update:
    """Assignments in order: each one sees what the ones before it have done.

    ``column`` names the target, the functions apply to it; ``condition(c) ... end_condition()`` guards what
    stands between, with the row as it is at that point. Guards don't nest.
    """

    def __init__(self) -> None:
        self.steps: list[tuple[str, Any, Any]] = []
        self._target: str | None = None
        self._guarded = False

    def column(self, name: str) -> Update:
        self._target = name
        return self

    def _step(self, kind: str, value: Any = None) -> Update:
        if self._target is None:
            raise ValueError("name a column first")
        self.steps.append((kind, self._target, value))
        return self

    def set(self, value: Any) -> Update:
        return self._step("set", value)

    def set_default(self) -> Update:
        return self._step("default")

    def operation(self, text: str) -> Update:
        return self._step("operation", text)

    def current_timestamp(self) -> Update:
        return self._step("now")

    def apply(self, fn: Fn) -> Update:
        """Any function of functions.scalar, or another from Column to Column."""
        return self._step("apply", fn)

    def condition(self, guard: Conditions) -> Update:
        if self._guarded:
            raise ValueError("conditions of updates don't nest")
        self._guarded = True
        self.steps.append(("guard", None, guard))
        return self

    def end_condition(self) -> Update:
        self._guarded = False
        self.steps.append(("end", None, None))
        return self


def changed_rows(rows: DataFrame, schema: Schema, update: Update, now: Column | None = None, hit: str | None = None) -> DataFrame:
    """The rows after the update, or those of them in which the boolean column ``hit`` is true; hidden columns stay."""
    types = schema.types
    guards, active = 0, hit
    out = rows
    for kind, target, value in update.steps:
        columns = {c: F.col(c) for c in schema.names}
        if kind == "guard":
            active = f"_seq_if{guards}"
            guards += 1
            test = fold(value.items, columns, types, False)
            out = out.withColumn(active, test if hit is None else F.col(hit) & test)
            continue
        if kind == "end":
            active = hit
            continue
        c = schema[target]
        if kind == "set":
            if not c.type.accepts(value):
                raise ValueError(f"{value!r} is not a {c.type.name}")
            new = literal(c.type.stored(value), types[target]).cast(types[target])
        elif kind == "default":
            new = literal(c.type.stored(c.default), types[target]).cast(types[target])
        elif kind == "operation":
            new = compile_arithmetic(value, columns, c.type.floating)
            for n in sorted(names(value)):  # a null operand is an error in an update
                new = F.when(F.col(n).isNull(), F.raise_error(F.lit(f"{n} is null in {value}")).cast(new_type(c.type.floating))).otherwise(new)
            new = new.cast(types[target])
        elif kind == "now":
            new = (F.localtimestamp() if now is None else now).cast(types[target])
        else:
            new = value(F.col(target)).cast(types[target])
        out = out.withColumn(target, new if active is None else F.when(F.col(active), new).otherwise(F.col(target)))
    return out.drop(*(f"_seq_if{k}" for k in range(guards)))


def new_type(floating: bool) -> str:
    return "double" if floating else "long"


def chosen(df: DataFrame, schema: Schema, q: Query) -> DataFrame:
    """The rows that an update or delete is about."""
    return page(df, schema, q)


def delete(df: DataFrame, schema: Schema, q: Query) -> DataFrame:
    """The table without the chosen rows."""
    if q.limit < 0 and q.begin <= 0:
        if q.where is None:
            return df.limit(0)
        columns = {c: F.col(c) for c in schema.names}
        return df.where(~holds(q.where.items, columns, schema.types))
    return df.join(chosen(df, schema, q).select(SEQ), SEQ, "left_anti").select(*df.columns)


def update(df: DataFrame, schema: Schema, q: Query, what: Update, now: Column | None = None) -> DataFrame:
    """The table with the chosen rows changed, in one pass unless a limit picks them."""
    if q.limit < 0 and q.begin <= 0:
        if q.where is None:
            return changed_rows(df, schema, what, now).select(*df.columns)
        columns = {c: F.col(c) for c in schema.names}
        marked = df.withColumn(HIT, holds(q.where.items, columns, schema.types))
    else:
        ids = chosen(df, schema, q).select(F.col(SEQ).alias("_seq_id"), F.lit(True).alias(HIT))
        marked = df.join(ids, F.col(SEQ) == F.col("_seq_id"), "left").withColumn(HIT, F.coalesce(HIT, F.lit(False)))
    return changed_rows(marked, schema, what, now, HIT).select(*df.columns)


def aligned(rows: DataFrame, schema: Schema, now: Column | None = None) -> DataFrame:
    """All columns of the table in order: an omitted one gets its default, an omitted TIMESTAMP the time now; a null stays null."""
    unknown = set(rows.columns) - set(schema.names) - {SEQ}
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    out = []
    for c in schema.columns:
        if c.name in rows.columns:
            out.append(F.col(c.name).cast(c.type.spark).alias(c.name))
        elif c.type.name == "TIMESTAMP":
            out.append((F.localtimestamp() if now is None else now).cast("timestamp_ntz").alias(c.name))
        else:
            out.append(literal(c.type.stored(c.default), c.type.spark).cast(c.type.spark).alias(c.name))
    return rows.select(*out, *([F.col(SEQ)] if SEQ in rows.columns else []))


#: Row numbers are cut into blocks of 2^BLOCK_BITS; only sums of blocks meet in one task.
BLOCK_BITS = 16


def auto_increment(rows: DataFrame, column: str, following: int) -> DataFrame:
    """Nulls get numbers in order of arrival: one more than all numbers before, given or made.

    A number v given behind k nulls makes the counter v + 1 there, hence v + 1 - k + g at g nulls. So within
    a block the running number of nulls and the running maximum of v + 1 - k are enough, and between blocks
    their totals, of which there is a row for each 65536 row numbers.
    """
    if not column:
        return rows
    own = Window.partitionBy("_seq_block").orderBy(SEQ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_seq_block").rowsBetween(Window.unboundedPreceding, -1)
    c, start = F.col(column), F.lit(following).cast("long")
    out = rows.withColumn("_seq_block", F.shiftright(SEQ, BLOCK_BITS))
    out = out.withColumn("_seq_nulls", F.sum(F.when(c.isNull(), 1).otherwise(0)).over(own))
    out = out.withColumn("_seq_lift", F.max(F.when(c.isNotNull(), c + 1 - F.col("_seq_nulls"))).over(own))
    blocks = out.groupBy(F.col("_seq_block").alias("_seq_b")).agg(F.max("_seq_nulls").alias("_seq_n"), F.max("_seq_lift").alias("_seq_l")).withColumnRenamed("_seq_b", "_seq_block")
    blocks = blocks.withColumn("_seq_p", F.coalesce(F.sum("_seq_n").over(before), F.lit(0)))
    blocks = blocks.withColumn("_seq_base", F.col("_seq_p") + F.greatest(start, F.max(F.col("_seq_l") - F.col("_seq_p")).over(before))).select("_seq_block", "_seq_base")
    made = F.greatest("_seq_base", "_seq_lift") + F.col("_seq_nulls") - 1
    return out.join(blocks, "_seq_block").withColumn(column, F.coalesce(c, made)).select(*rows.columns)
