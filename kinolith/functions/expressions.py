"""Equations written by users, translated into Columns; nothing is ever evaluated as code."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from kinolith.functions import maths

_CALLS: dict[str, Callable] = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "exp": F.exp, "sqrt": F.sqrt,
    "abs": F.abs, "sign": F.signum, "atan2": F.atan2, "hypot": F.hypot, "log": maths.log_or_inf, "mod": maths.floor_mod,
    "fmod": maths.trunc_mod, "round": F.rint,
    "floor": lambda c: F.floor(c).cast("double"), "ceil": lambda c: F.ceil(c).cast("double"),
    "where": lambda c, a, b: F.when(c, a).otherwise(b), "minimum": F.least, "maximum": F.greatest,
}
_BINARY: dict[type, Callable] = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide,
    ast.Pow: F.pow, ast.Mod: maths.floor_mod,
}
_COMPARE: dict[type, Callable] = {
    ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b,
}
_NAMES = {"pi": 3.141592653589793, "e": 2.718281828459045, "tau": 6.283185307179586}


def translate(equation: str, columns: dict[str, Column], parameters: dict[str, float] | None = None) -> Column:
    """Column of an equation over named columns, parameters and the known functions.

    Raises ValueError for names, calls and syntax outside that list. Division by zero gives null.
    """
    values: dict[str, Column] = {n: F.lit(v) for n, v in {**_NAMES, **(parameters or {})}.items()} | columns

    def walk(node: ast.AST) -> Column:
        match node:
            case ast.Expression(body=body):
                return walk(body)
            case ast.Constant(value=bool()):
                pass
            case ast.Constant(value=int() | float() as value):
                return F.lit(float(value))
            case ast.Name(id=name) if name in values:
                return values[name]
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -walk(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return walk(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](walk(a), walk(b))
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
                return _COMPARE[type(op)](walk(a), walk(b))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _CALLS:
                return _CALLS[name](*map(walk, args))
        raise ValueError(f"not allowed in an equation: {ast.dump(node)[:60]}")

    return walk(ast.parse(equation, mode="eval"))
