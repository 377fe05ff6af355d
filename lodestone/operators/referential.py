"""Referential actions over the graph of foreign keys: all post-images first, then their checks, then one swap."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.errors import ForeignKeyError
from lodestone.operators.constraints import referencing, validate
from lodestone.operators.select import SEQ
from lodestone.plans.conditions import literal
from lodestone.schema import CASCADE, RESTRICT, SET_DEFAULT, ForeignKey, Schema

OLD, NEW = "_seq_o", "_seq_n"


def rewritten(child: DataFrame, moved: DataFrame, key: ForeignKey, schema: Schema, action: str) -> DataFrame:
    """The child with the columns of ``key`` changed in rows whose key is an old one.

    ``moved`` has columns OLD + 0.. (old key) and, for CASCADE, NEW + 0.. (new key).
    """
    hit = F.col("_seq_hit")
    on = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"{OLD}{i}") for i, c in enumerate(key.columns)))
    joined = child.join(moved.withColumn("_seq_hit", F.lit(True)), on, "left")
    out = []
    for c in child.columns:
        if c not in key.columns:
            out.append(F.col(c))
            continue
        i, column = key.columns.index(c), schema[c]
        if action == CASCADE:
            new = F.col(f"{NEW}{i}")
        elif action == SET_DEFAULT:
            new = literal(column.type.stored(column.default), column.type.spark).cast(column.type.spark)
        else:
            new = F.lit(None).cast(column.type.spark)
        out.append(F.when(hit, new).otherwise(F.col(c)).alias(c))
    return joined.select(*out)


class Statement:
    """What one statement does to all tables. ``tables`` is read, ``after`` holds the tables that changed.

    ``keep`` fixes a post-image, for example by writing it, before anything else reads it; what it raises ends the statement.
    """

    def __init__(self, tables: dict[str, DataFrame], schemas: dict[str, Schema], keep: Callable[[str, DataFrame], DataFrame] = lambda _, df: df):
        self.before, self.schemas, self.keep, self.after = tables, schemas, keep, {}
        self.touched: dict[str, DataFrame] = {}

    def now(self, name: str) -> DataFrame:
        return self.after.get(name, self.before[name])

    def _children(self, name: str) -> list[tuple[str, ForeignKey]]:
        return [(t, k) for t, s in self.schemas.items() for k in s.foreign_keys if k.parent == name]

    def put(self, name: str, df: DataFrame, ids: DataFrame | None = None) -> DataFrame:
        """A table's next state and the numbers of the rows that changed."""
        df = self.after[name] = self.keep(name, df)
        if ids is not None:
            self.touched[name] = self.touched[name].union(ids).distinct() if name in self.touched else ids
        return df

    def delete(self, name: str, survivors: DataFrame, doomed: DataFrame) -> None:
        """Rows go, with what their foreign keys' onDelete says."""
        self.put(name, survivors)
        for child, key in self._children(name):
            rows = self.now(child)
            hit = referencing(rows, doomed, key)
            if key.on_delete == RESTRICT:
                if not hit.isEmpty():
                    raise ForeignKeyError(key.name, "is still referenced")
            elif key.on_delete == CASCADE:
                self.delete(child, referencing(rows, doomed, key, "left_anti"), hit)
            else:
                moved = doomed.select(*(F.col(p).alias(f"{OLD}{i}") for i, p in enumerate(key.parent_columns))).distinct()
                self._move(child, key, moved, key.on_delete, hit)

    def update(self, name: str, new: DataFrame, old_rows: DataFrame) -> None:
        """Rows change, with what their foreign keys' onUpdate says where a key really changed."""
        new = self.put(name, new, old_rows.select(SEQ))
        for child, key in self._children(name):
            old = old_rows.select(SEQ, *(F.col(p).alias(f"{OLD}{i}") for i, p in enumerate(key.parent_columns)))
            fresh = new.select(SEQ, *(F.col(p).alias(f"{NEW}{i}") for i, p in enumerate(key.parent_columns)))
            differs = reduce(lambda a, b: a | b, (~F.col(f"{OLD}{i}").eqNullSafe(F.col(f"{NEW}{i}")) for i in range(len(key.columns))))
            moved = old.join(fresh, SEQ).where(differs).drop(SEQ)
            rows = self.now(child)
            on = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"{OLD}{i}") for i, c in enumerate(key.columns)))
            hit = rows.join(moved, on, "left_semi")
            if key.on_update == RESTRICT:
                if not hit.isEmpty():
                    raise ForeignKeyError(key.name, "is still referenced")
            else:
                self._move(child, key, moved, key.on_update, hit)

    def _move(self, child: str, key: ForeignKey, moved: DataFrame, action: str, hit: DataFrame) -> None:
        rows = self.now(child)
        after = rewritten(rows, moved, key, self.schemas[child], action)
        self.update(child, after, hit)

    def check(self) -> dict[str, DataFrame]:
        """Validate all rows that changed against the final state of all tables."""
        for name, ids in self.touched.items():
            schema = self.schemas[name]
            parents = {k.parent: self.now(k.parent) for k in schema.foreign_keys}
            whole = self.now(name)
            validate(schema, whole.join(ids, SEQ, "left_semi").select(*whole.columns), whole, parents)
        return self.after
