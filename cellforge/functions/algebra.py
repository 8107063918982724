"""Map algebra: a small expression language over bands, compiled to one Catalyst column.

Grammar, loosest first: one comparison (not chained), sums, products, signs, then numbers, parentheses, calls, the
constants pi and e, and band names (letter case ignored). Arithmetic is IEEE double precision: dividing by zero gives an
infinity or NaN, comparisons give 1.0 or 0.0 and with NaN only ``!=`` holds. A result is null where a band that the
expression mentions is null, even in a branch not taken, and where it is NaN once rounded to single precision.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


class AlgebraError(ValueError):
    """The expression is malformed, or names something unknown."""


def nan_if(condition: Column, otherwise: Column) -> Column:
    return F.when(condition, F.lit(NAN)).otherwise(otherwise)


def either_nan(a: Column, b: Column) -> Column:
    return F.isnan(a) | F.isnan(b)


def divided(a: Column, b: Column) -> Column:
    """IEEE quotient; a negative zero is told apart by how it is written."""
    negative = (a < 0) != b.cast("string").startswith("-")
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(negative, F.lit(-INF)).otherwise(F.lit(INF))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def logarithm(x: Column, base: Callable[[Column], Column]) -> Column:
    return F.when(F.isnan(x) | (x < 0), F.lit(NAN)).when(x == 0, F.lit(-INF)).otherwise(base(x))


def least(a: Column, b: Column) -> Column:
    return nan_if(either_nan(a, b), F.least(a, b))


def greatest(a: Column, b: Column) -> Column:
    return nan_if(either_nan(a, b), F.greatest(a, b))


def chosen(c: Column, a: Column, b: Column) -> Column:
    return F.when((c != 0) | F.isnan(c), a).otherwise(b)


FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "abs": (1, F.abs),
    "sqrt": (1, F.sqrt),
    "exp": (1, F.exp),
    "log": (1, lambda x: logarithm(x, F.ln)),
    "log10": (1, lambda x: logarithm(x, F.log10)),
    "min": (2, least),
    "max": (2, greatest),
    "pow": (2, F.pow),
    "iif": (3, chosen),
}
CONSTANTS = {"pi": math.pi, "e": math.e}
COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: ~either_nan(a, b) & (a == b),
    "!=": lambda a, b: either_nan(a, b) | (a != b),
    "<=": lambda a, b: ~either_nan(a, b) & (a <= b),
    ">=": lambda a, b: ~either_nan(a, b) & (a >= b),
    "<": lambda a, b: ~either_nan(a, b) & (a < b),
    ">": lambda a, b: ~either_nan(a, b) & (a > b),
}
TOKEN = re.compile(r"\s*(?:(?P<number>[0-9.]+(?:[eE][+-]?[0-9]+)?)|(?P<name>[^\W\d]\w*)|(?P<sign>==|!=|<=|>=|[-+*/<>(),]))")


class Compiler:
    """One pass over the tokens; keeps which bands were mentioned."""

    def __init__(self, text: str, bands: Mapping[str, Column]) -> None:
        self.bands = {name.lower(): column.cast("double") for name, column in bands.items()}
        self.used: dict[str, Column] = {}
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = TOKEN.match(text, at)
            if m is None:
                raise AlgebraError(f"unexpected character at {at}: {text[at:].strip()[0]!r}")
            self.tokens.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "sign" else ""

    def take(self, *signs: str) -> str:
        found = self.peek()
        if found in signs:
            self.at += 1
            return found
        return ""

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise AlgebraError(f"{sign!r} expected")

    def compiled(self) -> Column:
        value = self.comparison()
        if self.at < len(self.tokens):
            raise AlgebraError(f"unexpected {self.tokens[self.at][1]!r}")
        return value

    def comparison(self) -> Column:
        left = self.sum()
        if sign := self.take(*COMPARISONS):
            return F.when(COMPARISONS[sign](left, self.sum()), F.lit(1.0)).otherwise(F.lit(0.0))
        return left

    def sum(self) -> Column:
        left = self.product()
        while sign := self.take("+", "-"):
            right = self.product()
            left = left + right if sign == "+" else left - right
        return left

    def product(self) -> Column:
        left = self.signed()
        while sign := self.take("*", "/"):
            right = self.signed()
            left = left * right if sign == "*" else divided(left, right)
        return left

    def signed(self) -> Column:
        if self.take("-"):
            return -self.signed()
        if self.take("+"):
            return self.signed()
        return self.primary()

    def primary(self) -> Column:
        if self.take("("):
            value = self.comparison()
            self.need(")")
            return value
        if self.at >= len(self.tokens):
            raise AlgebraError("the expression ends too soon")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            try:
                return F.lit(float(text))
            except ValueError:
                raise AlgebraError(f"no number: {text!r}") from None
        if kind != "name":
            raise AlgebraError(f"unexpected {text!r}")
        name = text.lower()
        if self.peek() == "(":
            return self.call(name)
        if name in CONSTANTS:
            return F.lit(CONSTANTS[name])
        if name not in self.bands:
            raise AlgebraError(f"unknown band {text!r}")
        self.used[name] = self.bands[name]
        return self.bands[name]

    def call(self, name: str) -> Column:
        if name not in FUNCTIONS:
            raise AlgebraError(f"unknown function {name!r}")
        self.need("(")
        arguments = []
        if self.peek() != ")":
            arguments.append(self.comparison())
            while self.take(","):
                arguments.append(self.comparison())
        self.need(")")
        arity, make = FUNCTIONS[name]
        if len(arguments) != arity:
            raise AlgebraError(f"{name} takes {arity} arguments, not {len(arguments)}")
        return make(*arguments)


def compile_expression(text: str, bands: Mapping[str, Column]) -> Column:
    """The expression as a float column over ``bands`` (name to column)."""
    compiler = Compiler(text, bands)
    value = compiler.compiled()
    for band in compiler.used.values():
        value = F.when(band.isNotNull(), value)
    stored = value.cast("float")
    return F.when(~F.isnan(stored), stored)
