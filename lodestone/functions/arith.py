"""Arithmetic text compiled once to a Column: + - * / % ^ ( ), signs, numbers and column names.

``^`` groups to the right and binds tighter than a sign: -2^2 is -4, 2^3^2 is 512. In long mode ``/``
truncates, decimal literals are illegal and a negative exponent gives 1; overflow and division by zero are
errors. In double mode division follows IEEE: infinities and NaN instead of errors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([^\W\d]\w*)|(.))")


def tokens(text: str) -> list[tuple[str, str]]:
    out = []
    for m in _TOKEN.finditer(text.rstrip()):
        kind = "number" if m[1] else "name" if m[2] else "sign"
        out.append((kind, m[1] or m[2] or m[3]))
        if kind == "sign" and m[3] not in "+-*/%^()":
            raise ValueError(f"unexpected {m[3]!r} in {text!r}")
    return out


def names(text: str) -> set[str]:
    """The columns that an expression reads."""
    return {t for kind, t in tokens(text) if kind == "name"}


class _Compiler:
    def __init__(self, text: str, columns: dict[str, Column], double: bool):
        self.text, self.columns, self.double, self.items, self.at = text, columns, double, tokens(text), 0

    def peek(self) -> str | None:
        return self.items[self.at][1] if self.at < len(self.items) and self.items[self.at][0] == "sign" else None

    def take(self) -> str:
        self.at += 1
        return self.items[self.at - 1][1]

    def run(self) -> Column:
        out = self.sums()
        if self.at < len(self.items):
            raise ValueError(f"unexpected {self.items[self.at][1]!r} in {self.text!r}")
        return out

    def sums(self) -> Column:
        out = self.products()
        while self.peek() in ("+", "-"):
            out = out + self.products() if self.take() == "+" else out - self.products()
        return out

    def products(self) -> Column:
        out = self.signed()
        while (op := self.peek()) in ("*", "/", "%"):
            self.take()
            right = self.signed()
            out = out * right if op == "*" else self.divide(out, right) if op == "/" else self.remainder(out, right)
        return out

    def signed(self) -> Column:
        if self.peek() in ("+", "-"):
            return self.signed() if self.take() == "+" else -self.signed()
        return self.power()

    def power(self) -> Column:
        base = self.atom()
        if self.peek() != "^":
            return base
        self.take()
        start = self.at
        exponent = self.signed() if self.peek() in ("+", "-") else self.power()
        if self.double:
            return F.pow(base, exponent)
        if self.at == start + 1 and self.items[start][0] == "number" and int(self.items[start][1]) <= 16:
            out = F.lit(1).cast("long")
            for _ in range(int(self.items[start][1])):
                out = out * base
            return out
        times = F.sequence(F.lit(1).cast("long"), exponent)
        return F.when(exponent <= 0, F.lit(1).cast("long")).otherwise(F.aggregate(F.when(exponent > 0, times), F.lit(1).cast("long"), lambda a, _: a * base))

    def atom(self) -> Column:
        if self.at >= len(self.items):
            raise ValueError(f"{self.text!r} ends too early")
        kind, t = self.items[self.at]
        self.at += 1
        if kind == "number":
            if self.double:
                return F.lit(float(t))
            if not t.isdigit():
                raise ValueError(f"{t} is not a whole number in {self.text!r}")
            return F.lit(int(t)).cast("long")
        if kind == "name":
            if t not in self.columns:
                raise ValueError(f"unknown column {t} in {self.text!r}")
            return self.columns[t].cast("double" if self.double else "long")
        if t == "(":
            out = self.sums()
            if self.peek() != ")":
                raise ValueError(f"a parenthesis is open in {self.text!r}")
            self.take()
            return out
        raise ValueError(f"unexpected {t!r} in {self.text!r}")

    def divide(self, a: Column, b: Column) -> Column:
        if not self.double:
            return F.call_function("div", a, b)
        inf = float("inf")
        return F.when(a.isNull() | b.isNull(), None).when(b != 0, a / b).when(a > 0, F.lit(inf)).when(a < 0, F.lit(-inf)).otherwise(F.lit(float("nan")))

    def remainder(self, a: Column, b: Column) -> Column:
        if not self.double:
            return a % b
        return F.when(a.isNull() | b.isNull(), None).when(b != 0, a % b).otherwise(F.lit(float("nan")))


def compile_arithmetic(text: str, columns: dict[str, Column], double: bool) -> Column:
    return _Compiler(text, columns, double).run()
