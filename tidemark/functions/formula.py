"""Row formulas: a small checked language compiled into one Catalyst column of doubles (infinite and undefined give NULL)."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_CHARS, MOST_DEPTH, MOST_NODES, MOST_CONSTANT, MOST_POWER = 1000, 20, 200, 1e12, 8


def formula(text: str, columns: list[str]) -> Column:
    """The column of a formula over the given columns; ValueError for anything outside the language."""
    if len(text) > MOST_CHARS:
        raise ValueError("formula: too long")
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as e:
        raise ValueError(f"formula: {e.msg}") from None
    if sum(1 for _ in ast.walk(tree)) > MOST_NODES:
        raise ValueError("formula: too many parts")
    used: set[str] = set()
    out = _number(tree.body, columns, used, 1)
    if not used:
        raise ValueError("formula: it uses no column")
    return finite(out)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _truth(node: ast.AST, columns: list[str], used: set[str], depth: int) -> Column:
    return _number(node, columns, used, depth) != 0


def _as_number(c: Column) -> Column:
    return c.cast("double")


def _floor_divide(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a, b)).cast("double")


def _number(node: ast.AST, columns: list[str], used: set[str], depth: int) -> Column:
    if depth > MOST_DEPTH:
        raise ValueError("formula: nested too deeply")
    of = lambda x: _number(x, columns, used, depth + 1)
    truth = lambda x: _truth(x, columns, used, depth + 1)
    match node:
        case ast.Constant(value=bool() | int() | float() as v):
            if abs(v) > MOST_CONSTANT:
                raise ValueError("formula: constant too large")
            return F.lit(float(v))
        case ast.Name(id=name):
            if name not in columns:
                raise ValueError(f"formula: no column {name}")
            used.add(name)
            return F.col(f"`{name}`").cast("double")
        case ast.BinOp(left=l, op=ast.Pow(), right=ast.Constant(value=int() | float() as p)) if abs(p) <= MOST_POWER:
            return finite(F.pow(of(l), F.lit(float(p))))
        case ast.BinOp(left=l, op=ast.Add(), right=r):
            return of(l) + of(r)
        case ast.BinOp(left=l, op=ast.Sub(), right=r):
            return of(l) - of(r)
        case ast.BinOp(left=l, op=ast.Mult(), right=r):
            return of(l) * of(r)
        case ast.BinOp(left=l, op=ast.Div(), right=r):
            return F.try_divide(of(l), of(r))
        case ast.BinOp(left=l, op=ast.FloorDiv(), right=r):
            return _floor_divide(of(l), of(r))
        case ast.BinOp(left=l, op=ast.Mod(), right=r):
            return of(l) - of(r) * _floor_divide(of(l), of(r))
        case ast.BinOp(left=l, op=ast.BitAnd(), right=r):
            return _as_number(truth(l) & truth(r))
        case ast.BinOp(left=l, op=ast.BitOr(), right=r):
            return _as_number(truth(l) | truth(r))
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -of(x)
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return of(x)
        case ast.UnaryOp(op=ast.Not() | ast.Invert(), operand=x):
            return _as_number(~truth(x))
        case ast.BoolOp(op=op, values=values):
            out = truth(values[0])
            for v in values[1:]:
                out = out & truth(v) if isinstance(op, ast.And) else out | truth(v)
            return _as_number(out)
        case ast.Compare(left=l, ops=ops, comparators=rights):
            out, a = F.lit(True), of(l)
            for op, right in zip(ops, rights, strict=True):
                b = of(right)
                test = {ast.Lt: a < b, ast.LtE: a <= b, ast.Gt: a > b, ast.GtE: a >= b, ast.Eq: a == b, ast.NotEq: a != b}.get(type(op))
                if test is None:
                    raise ValueError("formula: comparison not allowed")
                out, a = out & test, b
            return _as_number(out)
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
            if name == "where" and len(args) == 3:
                return F.when(truth(args[0]), of(args[1])).otherwise(of(args[2]))
            if name == "isnull" and len(args) == 1:
                return _as_number(finite(of(args[0])).isNull())
            got = [of(a) for a in args]
            if name == "log1p" and len(got) == 1:
                return F.when(got[0] > -1, F.log1p(got[0]))
            if name == "sqrt" and len(got) == 1:
                return F.when(got[0] >= 0, F.sqrt(got[0]))
            if name == "abs" and len(got) == 1:
                return F.abs(got[0])
            if name in ("minimum", "maximum") and len(got) == 2:
                pick = F.least(*got) if name == "minimum" else F.greatest(*got)
                return F.when(got[0].isNotNull() & got[1].isNotNull(), pick)
            if name == "clip" and len(got) == 3:
                return F.when(got[0].isNotNull(), F.least(F.greatest(got[0], got[1]), got[2]))
    raise ValueError(f"formula: {type(node).__name__} not allowed")
