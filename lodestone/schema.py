"""Table definitions: columns, checks and foreign keys, validated as a whole when the table is created."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from lodestone.errors import SchemaError
from lodestone.plans.conditions import Conditions, names_of
from lodestone.types import DataType

RESTRICT, CASCADE, SET_NULL, SET_DEFAULT = "RESTRICT", "CASCADE", "SET NULL", "SET DEFAULT"
ACTIONS = (RESTRICT, CASCADE, SET_NULL, SET_DEFAULT)


@dataclass
class Column:
    name: str
    type: DataType | str | None
    size: int | None = None
    primary: bool = False
    unique: bool = False
    index: bool = False
    required: bool = False
    auto_increment: bool = False
    default: Any = None

    def __post_init__(self) -> None:
        self.name = self.name.strip()
        if isinstance(self.type, str):
            self.type = DataType.of(self.type)
        if self.auto_increment:
            self.type = DataType.LONG
        if self.primary:
            self.required = True
        if self.type is not None and self.type.fixed_size is not None:
            self.size = self.type.fixed_size

    @property
    def indexed(self) -> bool:
        return self.primary or self.unique or self.index

    @property
    def constraints(self) -> str:
        flags = (("PRIMARY KEY", self.primary), ("UNIQUE", self.unique), ("INDEX", self.index), ("NOT NULL", self.required), ("AUTO INCREMENT", self.auto_increment))
        return ", ".join(n for n, on in flags if on)


@dataclass
class ForeignKey:
    name: str
    columns: list[str]
    parent: str
    parent_columns: list[str]
    on_delete: str = RESTRICT
    on_update: str = RESTRICT


@dataclass
class Schema:
    columns: list[Column] = field(default_factory=list)
    checks: dict[str, Conditions] = field(default_factory=dict)
    foreign_keys: list[ForeignKey] = field(default_factory=list)

    def column(self, name: str, type: DataType | str | None = None, size: int | None = None, **flags: Any) -> Schema:
        self.columns.append(Column(name, type, size, **flags))
        return self

    def check(self, name: str, condition: Conditions) -> Schema:
        if name in self.checks:
            raise SchemaError(f"check {name} exists")
        self.checks[name] = condition
        return self

    def foreign_key(self, name: str, columns: list[str] | str, parent: str, parent_columns: list[str] | str, on_delete: str = RESTRICT, on_update: str = RESTRICT) -> Schema:
        one = lambda x: [x] if isinstance(x, str) else list(x)
        self.foreign_keys.append(ForeignKey(name, one(columns), parent, one(parent_columns), on_delete, on_update))
        return self

    # -- lookups --------------------------------------------------------------------------------

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def __getitem__(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise SchemaError(f"unknown column {name}")

    @property
    def preferred(self) -> Column | None:
        """The column whose order is the table's: primary key, else the first unique, else the first indexed one."""
        for test in (lambda c: c.primary, lambda c: c.unique, lambda c: c.index):
            for c in self.columns:
                if test(c):
                    return c
        return None

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type.spark, True) for c in self.columns])

    @property
    def types(self) -> dict[str, T.DataType]:
        return {c.name: c.type.spark for c in self.columns}

    # -- validation -----------------------------------------------------------------------------

    def validate(self, tables: dict[str, Schema]) -> Schema:
        """Raises SchemaError at the first rule that is broken; ``tables`` are those a foreign key may name."""
        seen: set[str] = set()
        folded: set[str] = set()
        if not self.columns:
            raise SchemaError("a table needs a column")
        for c in self.columns:
            # names that differ in case only are one name to Spark; those that begin with _seq are the engine's own
            if not c.name or c.name.lower() in folded or c.name.lower().startswith("_seq"):
                raise SchemaError(f"bad or repeated column name {c.name!r}")
            seen.add(c.name)
            folded.add(c.name.lower())
            if c.type is None:
                raise SchemaError(f"column {c.name} has no type")
            if c.type.fixed_size is None and not (c.size and c.size > 0):
                raise SchemaError(f"column {c.name} needs a size")
            if c.primary + c.unique + c.index > 1:
                raise SchemaError(f"column {c.name}: only one of primary key, unique and index")
            if c.indexed and not c.type.indexable:
                raise SchemaError(f"column {c.name}: {c.type.name} cannot be indexed")
            if c.auto_increment and c.type is not DataType.LONG:
                raise SchemaError(f"column {c.name}: auto increment needs LONG")
            if not c.type.accepts(c.default):
                raise SchemaError(f"column {c.name}: the default is not a {c.type.name}")
        for what, n in (("primary key", sum(c.primary for c in self.columns)), ("auto increment", sum(c.auto_increment for c in self.columns))):
            if n > 1:
                raise SchemaError(f"more than one {what}")
        for name, check in self.checks.items():
            if unknown := names_of(check.items) - seen:
                raise SchemaError(f"check {name} names unknown columns {sorted(unknown)}")
        keys: set[str] = set()
        for k in self.foreign_keys:
            if k.name in keys:
                raise SchemaError(f"foreign key {k.name} exists")
            keys.add(k.name)
            if not k.columns or len(k.columns) != len(k.parent_columns):
                raise SchemaError(f"foreign key {k.name}: as many columns on both sides, one at least")
            if k.parent not in tables:
                raise SchemaError(f"foreign key {k.name}: no table {k.parent}")
            if k.on_delete not in ACTIONS or k.on_update not in ACTIONS:
                raise SchemaError(f"foreign key {k.name}: unknown action")
            for own, its in zip(k.columns, k.parent_columns, strict=True):
                parent = tables[k.parent][its]
                if not (parent.primary or parent.unique):
                    raise SchemaError(f"foreign key {k.name}: {its} is no primary key and not unique")
                if self[own].type is not parent.type:
                    raise SchemaError(f"foreign key {k.name}: types differ")
        return self
