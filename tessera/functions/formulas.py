"""Formulas in text, compiled to columns.

``+ - * / ^``, comparisons, ``and or not``, brackets, numbers, variables and functions; ``^`` binds to the right and before
a sign, comparisons after sums, ``and`` before ``or``. A formula becomes one column expression of doubles and truth values,
which Catalyst plans like any other. What can't be read is an error that says where.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Functions by name: number of arguments (None: one or more), and how they compute.
FUNCTIONS: dict[str, tuple[int | None, Callable[..., Column]]] = {
    "abs": (1, F.abs), "sqrt": (1, F.sqrt), "exp": (1, F.exp), "ln": (1, F.log), "sin": (1, F.sin), "cos": (1, F.cos), "tan": (1, F.tan), "floor": (1, lambda x: F.floor(x).cast("double")),
    "atan2": (2, F.atan2), "min": (None, lambda *x: F.least(*x) if len(x) > 1 else x[0]), "max": (None, lambda *x: F.greatest(*x) if len(x) > 1 else x[0]),
    "if": (3, lambda c, a, b: F.when(c, a).otherwise(b)),
}
CONSTANTS = {"pi": 3.141592653589793, "e": 2.718281828459045}

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op><=|>=|==|!=|[-+*/^()<>,]))")

#: Binding of binary operators, from loose to tight, with the kind of their operands and what they give.
_BINARY: list[dict[str, Callable[[Column, Column], Column]]] = [
    {"or": lambda a, b: a | b},
    {"and": lambda a, b: a & b},
    {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b},
    {"+": lambda a, b: a + b, "-": lambda a, b: a - b},
    {"*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b)},
]


class FormulaError(ValueError):
    """Carries the place in the text, from 0."""

    def __init__(self, text: str, at: int, what: str):
        super().__init__(f"{what} at {at} of {text!r}")
        self.at = at


class _Reader:
    def __init__(self, text: str, variables: dict[str, Column]):
        self.text, self.variables, self.tokens, self.next = text, variables, [], 0
        at, end = 0, len(text.rstrip())
        while at < end:
            m = _TOKEN.match(text, at)
            if not m:
                raise FormulaError(text, at + len(text[at:]) - len(text[at:].lstrip()), "unknown character")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup), m.start(m.lastgroup)))
            at = m.end()
        self.tokens.append(("end", "", end))

    def fail(self, what: str, at: int | None = None):
        raise FormulaError(self.text, self.tokens[self.next][2] if at is None else at, what)

    def take(self, *values: str) -> str | None:
        kind, value, _ = self.tokens[self.next]
        if kind in ("op", "name") and value in values:
            self.next += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            self.fail(f"{value} expected")

    def of(self, found: tuple[str, Column], kind: str, at: int) -> Column:
        if found[0] != kind:
            self.fail(f"{'a number' if kind == 'number' else 'a truth value'} expected", at)
        return found[1]

    def binary(self, level: int = 0) -> tuple[str, Column]:
        if level == len(_BINARY):
            return self.signed()
        if level == 2 and self.tokens[self.next][1] == "not":
            self.next += 1
            at = self.tokens[self.next][2]
            return "truth", ~self.of(self.binary(2), "truth", at)
        takes, gives = ("truth", "truth") if level < 2 else ("number", "truth" if level == 2 else "number")
        at = self.tokens[self.next][2]
        left = self.binary(level + 1)
        while op := self.take(*_BINARY[level]):
            right_at = self.tokens[self.next][2]
            right = self.binary(level + 1)
            left = gives, _BINARY[level][op](self.of(left, takes, at), self.of(right, takes, right_at))
            if level == 2:
                break  # comparisons don't chain
        return left

    def signed(self) -> tuple[str, Column]:
        sign = self.take("-", "+")
        if sign:
            at = self.tokens[self.next][2]
            value = self.of(self.signed(), "number", at)
            return "number", -value if sign == "-" else value
        at = self.tokens[self.next][2]
        base = self.atom()
        if self.take("^"):
            right = self.tokens[self.next][2]
            return "number", F.pow(self.of(base, "number", at), self.of(self.signed(), "number", right))
        return base

    def atom(self) -> tuple[str, Column]:
        kind, value, at = self.tokens[self.next]
        self.next += 1
        if kind == "number":
            return "number", F.lit(float(value))
        if kind == "op" and value == "(":
            found = self.binary()
            self.need(")")
            return found
        if kind == "name" and value in FUNCTIONS and self.take("("):
            return "number", self.call(value, at)
        if kind == "name" and value in self.variables:
            return "number", self.variables[value]
        if kind == "name" and value in CONSTANTS:
            return "number", F.lit(CONSTANTS[value])
        self.fail(f"unknown name {value}" if kind == "name" else "the text ends too early" if kind == "end" else f"{value} not expected", at)

    def call(self, name: str, at: int) -> Column:
        wanted, compute = FUNCTIONS[name]
        arguments = []
        while True:
            place = self.tokens[self.next][2]
            arguments.append(self.of(self.binary(), "truth" if name == "if" and not arguments else "number", place))
            if not self.take(","):
                break
        self.need(")")
        if wanted is not None and len(arguments) != wanted:
            self.fail(f"{name} takes {wanted} arguments, not {len(arguments)}", at)
        return compute(*arguments)


def compiled(text: str, variables: dict[str, Column]) -> Column:
    """The column of a formula over ``variables``, which are doubles. Division by zero gives null."""
    reader = _Reader(text, variables)
    found = reader.binary()
    if reader.tokens[reader.next][0] != "end":
        reader.fail(f"{reader.tokens[reader.next][1]} not expected")
    return found[1]


def by_row(formula: Column, texts: list[str], variables: dict[str, Column]) -> Column:
    """Each row's own formula, of the few ``texts`` that there are; null for another one."""
    out = F.lit(None).cast("double")
    for text in texts:
        out = F.when(formula == text, compiled(text, variables)).otherwise(out)
    return out
