"""Formulas as data: nested lists (as in JSON) compiled to Spark columns.

A node is a number, ["band", name], or [operator, operand, ...]. A missing band and arithmetic without
a finite result give null, and null spreads, also through min, max and clamp.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Expr = Any


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _all(*c: Column) -> Column:
    return reduce(lambda a, b: a & b, [x.isNotNull() for x in c])


UNARY = {
    "neg": lambda a: -a,
    "abs": F.abs,
    "relu": lambda a: F.when(a.isNotNull(), F.greatest(a, F.lit(0.0))),
    "sigmoid": lambda a: 1 / (1 + F.exp(-a)),
    "tanh": F.tanh,
    "exp": lambda a: finite(F.exp(a)),
    "sqrt": lambda a: F.when(a >= 0, F.sqrt(a)),
    "ln": lambda a: F.when(a > 0, F.log(a)),
    "floor": F.floor,
    "ceil": F.ceil,
    "round": lambda a: F.signum(a) * F.floor(F.abs(a) + 0.5),
}
BINARY = {
    "sub": lambda a, b: a - b,
    "div": lambda a, b: F.when(b != 0, a / b),
    "pow": lambda a, b: finite(F.pow(a, b)),
    "gt": lambda a, b: (a > b).cast("double"),
    "lt": lambda a, b: (a < b).cast("double"),
    "ge": lambda a, b: (a >= b).cast("double"),
    "le": lambda a, b: (a <= b).cast("double"),
}


def compile_expr(e: Expr) -> Column:
    if isinstance(e, int | float):
        return F.lit(float(e))
    op, *args = e
    if op == "band":
        return F.col(f"`{args[0]}`").cast("double")
    c = [compile_expr(a) for a in args]
    if op in UNARY:
        return UNARY[op](*c)
    if op in BINARY:
        return BINARY[op](*c)
    if op in ("add", "mul"):
        return reduce((lambda a, b: a + b) if op == "add" else (lambda a, b: a * b), c)
    if op in ("min", "max"):
        return F.when(_all(*c), (F.least if op == "min" else F.greatest)(*c))
    if op == "clamp":
        return F.when(_all(*c), F.greatest(F.least(c[0], c[2]), c[1]))
    if op == "linear":
        return c[0] * c[1] + c[2]
    if op == "if":
        return F.when(c[0].isNull(), None).when(c[0] != 0, c[1]).otherwise(c[2])
    raise ValueError(f"unknown operator {op!r}")


def bands_of(e: Expr) -> set[str]:
    if isinstance(e, int | float):
        return set()
    return {e[1]} if e[0] == "band" else set().union(*map(bands_of, e[1:]))


def evaluate(wide: DataFrame, recipes: dict[str, Expr | str], keys: list[str]) -> DataFrame:
    """One column per recipe, and <recipe>_skip = missing_input:<band> for the first null band."""
    out: list[Column] = []
    for name, e in recipes.items():
        e = json.loads(e) if isinstance(e, str) else e
        skip = F.coalesce(*[F.when(F.col(f"`{b}`").isNull(), F.lit(f"missing_input:{b}")) for b in sorted(bands_of(e))], F.lit(None).cast("string"))
        out += [compile_expr(e).alias(name), skip.alias(f"{name}_skip")]
    return wide.select(*keys, *out)


def _band(name: str) -> Expr:
    return ["band", name]


def steps(x: Expr, cuts: list[float]) -> Expr:
    """Number of cuts that x reaches."""
    return ["add", *[["ge", x, c] for c in cuts]]


# Weights and cut points of the recipes. Cut points between the published samples of the
# precipitation and vegetation classes are choices made here.
RECIPES: dict[str, Expr] = {
    "flood_risk": [
        "add",
        ["mul", 0.55, ["div", _band("swr"), 100]],
        ["mul", 0.25, ["if", ["gt", ["abs", ["sub", _band("cop"), _band("gmrt")]], 5], 0.5, 1], ["div", ["relu", ["sub", 50, _band("cop")]], 50]],
        ["mul", 0.2, ["sigmoid", ["div", ["sub", -15, _band("s1")], 2]]],
    ],
    "vpd": ["mul", 0.6108, ["exp", ["div", ["mul", 17.27, _band("temp")], ["add", _band("temp"), 237.3]]], ["sub", 1, ["div", _band("rh"), 100]]],
    "water": ["sigmoid", ["div", ["sub", -15, _band("s1")], 2]],
    "vegetation": ["if", ["lt", _band("ndvi"), 0], 0, ["min", 4, ["add", 1, ["gt", _band("ndvi"), 0.1], ["gt", _band("ndvi"), 0.3], ["gt", _band("ndvi"), 0.5]]]],
    "precipitation": steps(_band("precip"), [0.1, 1, 5, 10, 60]),
}
