"""Conditions: predicates on columns or arithmetic, joined by AND and OR strictly from left to right.

In a WHERE, comparisons are null-safe: ``is_equal(None)`` finds nulls and ``is_not_equal(v)`` keeps them. In a
CHECK or an update's condition a null operand makes the predicate false, whatever it says.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.arith import compile_arithmetic, names

FLOAT_MAX = 3.4028234663852886e38


def literal(value: Any, to: T.DataType | None = None) -> Column:
    """A foldable literal of the column's own type where that loses nothing, so that the predicate reaches the scan."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime) and value.tzinfo is None:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(value, dt.time):
        return F.lit(((value.hour * 60 + value.minute) * 60 + value.second) * 10**9 + value.microsecond * 1000)
    if isinstance(value, uuid.UUID):
        return F.lit(str(value))
    if isinstance(value, int) and not isinstance(value, bool):
        bits = {T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}.get(type(to))
        if bits and -(1 << bits) <= value < 1 << bits:
            return F.lit(value).cast(to)
        if isinstance(to, T.FloatType) and abs(value) <= 1 << 24:
            return F.lit(float(value)).cast(to)
        if isinstance(to, T.DoubleType | T.FloatType) and abs(value) <= 1 << 53:
            return F.lit(float(value))
    if isinstance(value, float):
        if isinstance(to, T.FloatType) and not FLOAT_MAX < abs(value) < float("inf"):
            return F.lit(value).cast(to)  # the FLOAT that is written so
        if isinstance(to, T.IntegralType) and value.is_integer() and abs(value) <= 1 << 53:
            return literal(int(value), to)
    return F.lit(value)


_ORDER = {">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v}


@dataclass
class Predicate:
    """All comparisons of one operand; a comparison given twice counts as given last."""

    column: str | None
    text: str | None = None
    tests: dict[str, Any] = field(default_factory=dict)

    def operand(self, columns: dict[str, Column]) -> Column:
        if self.text is not None:
            return compile_arithmetic(self.text, columns, double=True)
        if self.column not in columns:
            raise ValueError(f"unknown column {self.column}")
        return columns[self.column]

    def to_column(self, columns: dict[str, Column], types: dict[str, T.DataType], where: bool) -> Column:
        c = self.operand(columns)
        to = types.get(self.column) if self.column else T.DoubleType()
        out = None
        for op, v in self.tests.items():
            if op in _ORDER:
                if v is None:
                    raise ValueError("null has no order")
                one = _ORDER[op](c, literal(v, to))  # bare, so that the bound reaches the scan; null where the operand is
            else:
                one = c.isNull() if v is None else c.eqNullSafe(literal(v, to))
                one = ~one if op == "!=" else one
            out = one if out is None else out & one
        out = F.lit(True if where else False) if out is None else out
        return out if where else F.when(c.isNull(), F.lit(False)).otherwise(out)

    def names(self) -> set[str]:
        return names(self.text) if self.text is not None else {self.column or ""}


Item = tuple[str, "Predicate | list"]


class Conditions:
    """A fluent builder. ``column`` or ``open`` needs AND() or OR() before it, except at the start of a group."""

    def __init__(self, nested: bool = True):
        self._nested, self._stack, self._clause = nested, [[]], ["AND"]
        self._last: Predicate | None = None

    @property
    def items(self) -> list[Item]:
        if len(self._stack) > 1:
            raise ValueError("a group is still open")
        return self._stack[0]

    def _add(self, x: Predicate | list) -> None:
        if self._stack[-1] and not self._clause[-1]:
            raise ValueError("use OR() or AND() first")
        self._stack[-1].append((self._clause[-1] or "AND", x))
        self._clause[-1] = ""

    def column(self, name: str) -> Conditions:
        self._last = Predicate(name)
        self._add(self._last)
        return self

    def expression(self, text: str) -> Conditions:
        if not self._nested:
            raise ValueError("a WHERE takes columns only")
        self._last = Predicate(None, text)
        self._add(self._last)
        return self

    def AND(self) -> Conditions:  # noqa: N802
        self._clause[-1] = "AND"
        return self

    def OR(self) -> Conditions:  # noqa: N802
        self._clause[-1] = "OR"
        return self

    def open(self) -> Conditions:
        if not self._nested:
            raise ValueError("a WHERE has no groups")
        group: list[Item] = []
        self._add(group)
        self._stack.append(group)
        self._clause.append("AND")
        return self

    def close(self) -> Conditions:
        if len(self._stack) == 1:
            raise ValueError("no group is open")
        self._stack.pop()
        self._clause.pop()
        return self

    def _test(self, op: str, value: Any) -> Conditions:
        if self._last is None:
            raise ValueError("name a column first")
        self._last.tests[op] = value
        return self

    def is_equal(self, value: Any) -> Conditions:
        return self._test("=", value)

    def is_not_equal(self, value: Any) -> Conditions:
        return self._test("!=", value)

    def is_null(self) -> Conditions:
        return self._test("=", None)

    def not_null(self) -> Conditions:
        return self._test("!=", None)

    def is_bigger(self, value: Any) -> Conditions:
        return self._test(">", value)

    def is_smaller(self, value: Any) -> Conditions:
        return self._test("<", value)

    def is_bigger_or_equal(self, value: Any) -> Conditions:
        return self._test(">=", value)

    def is_smaller_or_equal(self, value: Any) -> Conditions:
        return self._test("<=", value)


def where(column: str) -> Conditions:
    return Conditions(nested=False).column(column)


def condition(column: str | None = None) -> Conditions:
    return Conditions().column(column) if column else Conditions()


def names_of(items: list[Item]) -> set[str]:
    return set().union(*(names_of(x) if isinstance(x, list) else x.names() for _, x in items)) if items else set()


def fold(items: list[Item], columns: dict[str, Column], types: dict[str, T.DataType], where: bool) -> Column:
    """One Column: (((a op b) op c) ...); an empty group is false.

    In a WHERE it may be null instead of false, which a filter takes alike; ``holds`` is for other uses.
    """
    out: Column | None = None
    for clause, x in items:
        one = fold(x, columns, types, where) if isinstance(x, list) else x.to_column(columns, types, where)
        out = one if out is None else out & one if clause == "AND" else out | one
    return F.lit(False) if out is None else out


def holds(items: list[Item], columns: dict[str, Column], types: dict[str, T.DataType]) -> Column:
    """Whether a row matches a WHERE: true or false."""
    return F.coalesce(fold(items, columns, types, True), F.lit(False))


def access_rank(items: list[Item], columns: dict[str, Column], types: dict[str, T.DataType]) -> Column:
    """Null for rows that don't match, else the number of the predicate that brought the row in."""
    rank: Column | None = None
    for k, (clause, x) in enumerate(items):
        one = x.to_column(columns, types, True)
        if rank is None:
            rank = F.when(one, F.lit(0))
        else:
            rank = F.when(one, rank) if clause == "AND" else F.coalesce(rank, F.when(one, F.lit(k)))
    return rank
