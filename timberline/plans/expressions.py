"""Expressions of the query language as values."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions.scalars import FUNCTIONS, arithmetic
from timberline.functions.values import Value
from timberline.lang import ast as A
from timberline.plans.frame import Frame


def compile_expression(e: object, frame: Frame) -> Value:
    match e:
        case A.Number(v, _):
            return Value(F.lit(v), True)
        case A.Text(v):
            return Value(F.lit(v))
        case A.Field(n):
            return frame.value(n)
        case A.Call(n, args):
            return FUNCTIONS[n](*[compile_expression(a, frame) for a in args])
        case A.Negate(t):
            return Value(-compile_expression(t, frame).number().cast("double"), True)
        case A.Binary(op, a, b):
            return arithmetic(op, compile_expression(a, frame), compile_expression(b, frame))
    raise TypeError(e)


def fields_of(e: object) -> set[str]:
    """Names of the fields that an expression reads."""
    match e:
        case A.Field(n):
            return {n}
        case A.Call(_, args):
            return set().union(*map(fields_of, args))
        case A.Negate(t):
            return fields_of(t)
        case A.Binary(_, a, b):
            return fields_of(a) | fields_of(b)
    return set()
