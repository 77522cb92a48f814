"""The rule language: a whitelisted expression becomes a Catalyst column with two-valued logic."""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.indicators import by_key


class RuleError(ValueError):
    """The expression isn't in the language."""


@dataclass(frozen=True)
class RuleFunction:
    """A function of the language: columns in, a column out; lookback is how many sessions back it reads."""

    name: str
    arity: int
    lookback: int
    make: Callable[..., Column]


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _prev(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_key())


#: Functions by name. Register more with FUNCTIONS["name"] = RuleFunction(...).
FUNCTIONS: dict[str, RuleFunction] = {
    "prev": RuleFunction("prev", 2, -1, lambda x, n: _prev(x, n)),
    "bullish_cross": RuleFunction("bullish_cross", 2, 1, lambda a, b: _true(a > b) & _true(_prev(a) <= _prev(b))),
    "bearish_cross": RuleFunction("bearish_cross", 2, 1, lambda a, b: _true(a < b) & _true(_prev(a) >= _prev(b))),
}


@dataclass
class Expression:
    """A compiled expression and what it reads."""

    source: str
    column: Column
    variables: set[str] = field(default_factory=set)
    functions: set[str] = field(default_factory=set)
    lookback: int = 0


_COMPARE = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b}


def _divided(a: Column, b: Column) -> Column:
    """Division without errors: x/0 is infinite with the sign of x, 0/0 and missing values are missing."""
    inf = F.lit(float("inf"))
    return F.when(b != 0, a / b).when((b == 0) & (a > 0), inf).when((b == 0) & (a < 0), -inf)


def compile_expression(source: str, functions: dict[str, RuleFunction] | None = None) -> Expression:
    """Numbers, texts, names, + - * /, unary -, not, and, or, chained comparisons, calls by position. Nothing else.

    A comparison with a missing value is false, `!=` is then true, and `not` turns either round; so no condition is
    ever missing itself.
    """
    functions = FUNCTIONS if functions is None else functions
    try:
        tree = ast.parse(source.strip(), mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise RuleError(f"can't read {source!r}") from e
    out = Expression(source, F.lit(None))

    def boolean(node: ast.AST) -> Column:
        return _true(build(node).cast("boolean"))

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=bool() | int() | float() | str() as v):
                return F.lit(v)
            case ast.Name(id=name):
                out.variables.add(name)
                return F.col(f"`{name}`")
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -build(x)
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~boolean(x)
            case ast.BinOp(left=a, op=ast.Add() | ast.Sub() | ast.Mult() | ast.Div() as op, right=b):
                x, y = build(a), build(b)
                match op:
                    case ast.Add():
                        return x + y
                    case ast.Sub():
                        return x - y
                    case ast.Mult():
                        return x * y
                return _divided(x, y)
            case ast.BoolOp(op=op, values=values):
                parts = [boolean(v) for v in values]
                whole = parts[0]
                for p in parts[1:]:
                    whole = whole & p if isinstance(op, ast.And) else whole | p
                return whole
            case ast.Compare(left=left, ops=ops, comparators=others):
                whole, a = F.lit(True), build(left)
                for op, other in zip(ops, others, strict=True):
                    b = build(other)
                    if isinstance(op, ast.NotEq):
                        whole = whole & ~_true(a == b)
                    elif type(op) in _COMPARE:
                        whole = whole & _true(_COMPARE[type(op)](a, b))
                    else:
                        raise RuleError(f"{type(op).__name__} isn't in the language: {source!r}")
                    a = b
                return whole
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in functions:
                f = functions[name]
                if len(args) != f.arity or any(isinstance(a, ast.Starred) for a in args):
                    raise RuleError(f"{name} takes {f.arity} arguments: {source!r}")
                out.functions.add(name)
                if f.lookback < 0:
                    match args[1]:
                        case ast.Constant(value=int() as n) if n > 0 and not isinstance(n, bool):
                            out.lookback = max(out.lookback, n)
                            return f.make(build(args[0]), n)
                    raise RuleError(f"{name} takes a positive whole number: {source!r}")
                out.lookback = max(out.lookback, f.lookback)
                return f.make(*[build(a) for a in args])
        raise RuleError(f"{type(node).__name__} isn't in the language: {source!r}")

    out.column = build(tree)
    return out


def check_variables(expressions: list[Expression], available: list[str]) -> None:
    """RuleError if an expression reads a column that isn't there."""
    unknown = sorted({v for e in expressions for v in e.variables} - set(available))
    if unknown:
        raise RuleError(f"unknown variables: {', '.join(unknown)}")
