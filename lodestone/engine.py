"""The engine: databases, tables, statements and nested transactions over immutable parts.

A table's state is a list of written parts. A statement writes the parts it needs first, checks what it wrote, and
only then makes them the table's state: an error in an expression, a lost executor that ends the job or a broken
rule leaves every table as it was, and nothing is computed again when the table is read. An insert writes its own
rows only; an update or delete writes each changed table once.
"""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import DatabaseError, EntryValidationError, SchemaError
from lodestone.operators import rewrite
from lodestone.operators.constraints import validate
from lodestone.operators.referential import Statement
from lodestone.operators.rewrite import Update
from lodestone.operators.select import SEQ, Query, select
from lodestone.plans.conditions import Conditions, where
from lodestone.schema import Schema
from lodestone.scratch import made, numbered, release
from lodestone.sources.storage import Parts, Storage

#: An insert that would give a table more parts than this merges the small ones, into files of about FILE_BYTES.
PARTS, FILE_BYTES = 64, 1 << 27


class Select:
    """``select("a, b").from_("t").where(...).begin(n).limit(n).ASC("a")``, then ``to_df`` or ``fetch``."""

    def __init__(self, engine: Engine, columns: str | None):
        self._engine, self._query, self._table = engine, Query(columns=columns), ""

    def from_(self, table: str) -> Select:
        self._table = table
        return self

    def where(self, condition: Conditions) -> Select:
        self._query.where = condition
        return self

    def begin(self, n: int) -> Select:
        self._query.begin = n
        return self

    def limit(self, n: int) -> Select:
        self._query.limit = n
        return self

    def ASC(self, column: str) -> Select:  # noqa: N802
        self._query.order = (column, True)
        return self

    def DEC(self, column: str) -> Select:  # noqa: N802
        self._query.order = (column, False)
        return self

    def to_df(self, ordered: bool = False) -> DataFrame:
        return select(self._engine.table(self._table), self._engine.schema(self._table), self._query, ordered)

    def fetch(self) -> list[T.Row]:
        """The rows in order, with Python values of the columns' types."""
        df = self.to_df(ordered=True)
        types = [self._engine.schema(self._table)[n].type for n in df.columns]
        make = T.Row(*df.columns)
        return [make(*(t.loaded(v) for t, v in zip(types, r, strict=True))) for r in df.collect()]


class _Database:
    def __init__(self) -> None:
        self.schemas: dict[str, Schema] = {}
        self.layers: list[tuple[str, dict[str, Parts]]] = [("", {})]
        self.counters: dict[str, int] = {}
        self.following: dict[str, int] = {}
        self.opened: dict[str, tuple[Parts, DataFrame]] = {}


class Engine:
    def __init__(self, spark: SparkSession, path: str | None = None):
        """Tables live under ``path`` from commit to commit; without one, in the scratch folder while the driver runs."""
        self.spark = spark
        self.storage = Storage(spark, path)
        self.databases: dict[str, _Database] = {}
        self.name = ""

    # -- databases and tables -------------------------------------------------------------------

    def add_database(self, name: str) -> Engine:
        if name in self.databases:
            raise SchemaError(f"database {name} exists")
        self.databases[name] = _Database()
        self.name = self.name or name
        return self

    def select_database(self, name: str) -> Engine:
        """Make another database the current one; all that is open in the one before is committed first."""
        if name not in self.databases:
            raise SchemaError(f"no database {name}")
        if self.name and self.name != name:
            self._commit_all()
        self.name = name
        return self

    def drop_database(self, name: str) -> None:
        """With its tables and files; if it was the current one, none is."""
        if name not in self.databases:
            raise SchemaError(f"no database {name}")
        self.storage.drop(name)
        del self.databases[name]
        self.name = "" if self.name == name else self.name

    @property
    def _db(self) -> _Database:
        if not self.name:
            raise DatabaseError("no database is selected")
        return self.databases[self.name]

    def create_table(self, name: str, schema: Schema, rows: DataFrame | None = None) -> Engine:
        """A new table; it is opened from its last snapshot if there is one, or made of ``rows``, which are not checked."""
        db = self._db
        if name in db.schemas:
            raise SchemaError(f"table {name} exists")
        schema.validate(db.schemas)
        if rows is None:
            parts = self.storage.tables(self.name).get(name, ())
        else:
            mark = made()
            parts = (self.storage.write(self.name, name, numbered(rewrite.aligned(rows, schema), SEQ)),)
            release(self.spark, mark)
        db.schemas[name] = schema
        db.layers[0][1][name] = parts
        self._restart(name)
        return self

    def _restart(self, name: str) -> None:
        db, own = self._db, [c.name for c in self._db.schemas[name].columns if c.auto_increment]
        got = self.table(name).agg(F.max(SEQ).alias("s"), *(F.max(c).alias("a") for c in own)).first()
        db.counters[name] = -1 if got["s"] is None else got["s"]
        db.following[name] = 1 + (got["a"] or 0) if own else 1

    def drop_table(self, name: str) -> None:
        """Refused while another table's foreign key names it; a table that does not exist is no error."""
        db = self._db
        users = [t for t, s in db.schemas.items() if t != name and any(k.parent == name for k in s.foreign_keys)]
        if users:
            raise SchemaError(f"table {name} is the parent of {users}")
        if db.schemas.pop(name, None) is None:
            return
        for _, layer in db.layers:
            layer.pop(name, None)
        self.storage.point(self.name, {t: p for t, p in self.storage.tables(self.name).items() if t != name})
        self.storage.drop(self.name, name)

    def schema(self, table: str) -> Schema:
        if table not in self._db.schemas:
            raise SchemaError(f"no table {table}")
        return self._db.schemas[table]

    def _parts(self, name: str) -> Parts:
        return next(layer[name] for _, layer in reversed(self._db.layers) if name in layer)

    def table(self, name: str) -> DataFrame:
        """The table as the innermost transaction sees it, with the hidden row number."""
        schema, parts, db = self.schema(name), self._parts(name), self._db
        if name not in db.opened or db.opened[name][0] != parts:
            db.opened[name] = parts, self.storage.open(self.name, name, parts, schema)
        return db.opened[name][1]

    def size(self, name: str) -> int:
        """How many rows a table has."""
        return self.table(name).count()

    def describe_table(self, name: str) -> DataFrame:
        """column, type, size, constraints, default."""
        rows = [(c.name, c.type.name, c.size, c.constraints, None if c.default is None else c.type.format(c.default)) for c in self.schema(name).columns]
        return self.spark.createDataFrame(rows, "column string, type string, size int, constraints string, default string")

    def describe_database(self) -> DataFrame:
        rows = [(t, c.name, c.type.name) for t, s in sorted(self._db.schemas.items()) for c in s.columns]
        return self.spark.createDataFrame(rows, "table string, column string, type string")

    def describe_all(self) -> DataFrame:
        """Every column of every table of every database."""
        rows = [(d, t, c.name, c.type.name) for d, db in sorted(self.databases.items()) for t, s in sorted(db.schemas.items()) for c in s.columns]
        return self.spark.createDataFrame(rows, "database string, table string, column string, type string")

    # -- statements -----------------------------------------------------------------------------

    def select(self, columns: str | None = "*") -> Select:
        return Select(self, columns)

    def contains(self, table: str, column: str, value: Any) -> bool:
        self.schema(table)[column]
        return not select(self.table(table), self.schema(table), Query(where(column).is_equal(value))).limit(1).isEmpty()

    def insert(self, table: str, rows: dict | list[dict]) -> int:
        """Append rows, all or none; how many."""
        rows = [rows] if isinstance(rows, dict) else list(rows)
        schema = self.schema(table)
        rows = [{k.strip(): v for k, v in r.items()} for r in rows]
        now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
        values = []
        for k, r in enumerate(rows):
            if unknown := set(r) - set(schema.names):
                raise EntryValidationError(f"unknown columns {sorted(unknown)}")
            one = [r[c.name] if c.name in r else now if c.type.name == "TIMESTAMP" else c.default for c in schema.columns]
            for c, v in zip(schema.columns, one, strict=True):
                if not c.type.accepts(v):
                    raise EntryValidationError(f"{c.name}: {v!r} is not a {c.type.name}")
            values.append((*(c.type.stored(v) for c, v in zip(schema.columns, one, strict=True)), k))
        if not values:
            return 0
        return self.insert_df(table, self.spark.createDataFrame(values, T.StructType([*schema.struct.fields, T.StructField(SEQ, T.LongType())])))

    insert_unsafe = insert

    def insert_df(self, table: str, rows: DataFrame) -> int:
        """Append a DataFrame (an extension): the same defaults, numbering and checks, without rows on the driver."""
        schema, db, mark = self.schema(table), self._db, made()
        start = db.counters[table] + 1
        now = F.lit(str(dt.datetime.now(dt.UTC).replace(tzinfo=None)))
        given = SEQ in rows.columns  # rows of ``insert`` come with dense numbers from 0 on
        rows = rewrite.aligned(rows, schema, now)
        rows = rows.withColumn(SEQ, F.col(SEQ) + start) if given else numbered(rows, SEQ, start)
        own = next((c.name for c in schema.columns if c.auto_increment), "")
        with _Draft(self) as draft:
            rows = draft.keep(table, rewrite.auto_increment(rows, own, db.following[table]))
            parts = (*self._parts(table), draft.parts[table])
            whole = self.storage.open(self.name, table, parts, schema)
            validate(schema, rows, whole, {k.parent: self.table(k.parent) for k in schema.foreign_keys})
            got = rows.agg(F.count("*").alias("n"), F.max(SEQ).alias("s"), *([F.max(own).alias("a")] if own else [])).first()
            if got["n"]:
                if len(parts) > PARTS:
                    parts = self._merged(table, parts, draft)
                db.counters[table] = got["s"]
                if own and got["a"] is not None:  # like a sequence, not rolled back
                    db.following[table] = max(db.following[table], got["a"] + 1)
                draft.swap({table: parts})
        release(self.spark, mark)
        return got["n"]

    def _merged(self, table: str, parts: Parts, draft: _Draft) -> Parts:
        """Half of the parts, the smaller ones, as one, with all that are no larger than what is merged by then.

        So a row is written again only when its part at least doubles or most parts are larger, not with every PARTS inserts.
        """
        sizes = {p: self.storage.bytes(self.name, table, p) for p in parts}
        small, total = [], 0
        for p in sorted(parts, key=sizes.__getitem__):
            if len(small) > PARTS // 2 and sizes[p] > total:
                break
            small.append(p)
            total += sizes[p]
        rows = self.storage.open(self.name, table, tuple(small), self.schema(table))
        draft.keep(table, rows.coalesce(-(-total // FILE_BYTES) or 1))
        return (*(p for p in parts if p not in small), draft.parts[table])

    def update(self, table: str, what: Update, condition: Conditions | None = None, limit: int = -1, begin: int = 0) -> int:
        """Change rows, all or none; how many were chosen."""
        schema, df, q, mark = self.schema(table), self.table(table), Query(condition, begin, limit), made()
        old = rewrite.chosen(df, schema, q)
        n = old.count()
        if n:
            now = F.lit(str(dt.datetime.now(dt.UTC).replace(tzinfo=None)))
            with _Draft(self) as draft:
                statement = Statement(self._tables(), self._db.schemas, draft.keep)
                statement.update(table, rewrite.update(df, schema, q, what, now), old)
                draft.swap(dict.fromkeys(statement.check()))
        release(self.spark, mark)
        return n

    def delete(self, table: str, condition: Conditions | None = None, limit: int = -1, begin: int = 0) -> int:
        """Remove rows and what their foreign keys say; how many rows of this table."""
        schema, df, q, mark = self.schema(table), self.table(table), Query(condition, begin, limit), made()
        doomed = rewrite.chosen(df, schema, q)
        n = doomed.count()
        if n:
            with _Draft(self) as draft:
                statement = Statement(self._tables(), self._db.schemas, draft.keep)
                statement.delete(table, rewrite.delete(df, schema, q), doomed)
                draft.swap(dict.fromkeys(statement.check()))
        release(self.spark, mark)
        return n

    def _tables(self) -> dict[str, DataFrame]:
        return {t: self.table(t) for t in self._db.schemas}

    # -- transactions ---------------------------------------------------------------------------

    def begin(self, name: str = "") -> Engine:
        """A transaction inside the current one."""
        self._db.layers.append((name, {}))
        return self

    def commit(self) -> Engine:
        """The innermost transaction's tables become its parent's; outside of any, all tables are committed at once."""
        db = self._db
        if len(db.layers) > 1:
            _, layer = db.layers.pop()
            db.layers[-1][1].update(layer)
        else:
            # tables of earlier runs that are not declared yet stay as they are
            self.storage.point(self.name, self.storage.tables(self.name) | db.layers[0][1])
        return self

    def _commit_all(self) -> None:
        while len(self._db.layers) > 1:
            self.commit()
        self.commit()

    def rollback(self) -> Engine:
        """Forget the innermost transaction; outside of any there is nothing to forget."""
        if len(self._db.layers) > 1:
            self._db.layers.pop()
        return self

    def close(self) -> None:
        """Commit everything that is open in every database; the current one stays the current one."""
        current = self.name
        for self.name in self.databases:
            self._commit_all()
        self.name = current


class _Draft:
    """The parts that a statement writes: they become the state of their tables at ``swap``, or are deleted."""

    def __init__(self, engine: Engine):
        self._engine, self._made, self.parts = engine, [], {}

    def __enter__(self) -> _Draft:
        return self

    def keep(self, table: str, df: DataFrame) -> DataFrame:
        """Write a table's next state; what stands there now is read from then on."""
        e = self._engine
        self.parts[table] = e.storage.write(e.name, table, df)
        self._made.append((table, self.parts[table]))
        return e.storage.open(e.name, table, (self.parts[table],), e.schema(table))

    def swap(self, tables: dict[str, Parts | None]) -> None:
        """The new parts of tables; None is the one that was kept last."""
        named = {t: p or (self.parts[t],) for t, p in tables.items()}
        self._engine._db.layers[-1][1].update(named)
        self._made = [(t, p) for t, p in self._made if p not in named.get(t, ())]

    def __exit__(self, *_: object) -> None:
        for table, part in self._made:
            self._engine.storage.forget(self._engine.name, table, part)
