"""The scalar functions and arithmetic of expressions, as column compositions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.values import Value

NAN = float("nan")


def _num(c: Column) -> Value:
    return Value(c.cast("double"), True)


def _math(f: Callable[[Column], Column]) -> Callable[..., Value]:
    return lambda x: _num(f(x.number()))


def _log(f: Callable[[Column], Column]) -> Callable[..., Value]:
    """Logarithms of negatives are NaN and of zero -Inf, not null."""

    def log(x: Value) -> Value:
        n = x.number()
        return _num(F.when(n < 0, F.lit(NAN)).when(n == 0, F.lit(float("-inf"))).otherwise(f(n)))

    return log


def _round(x: Value, digits: Value | None = None) -> Value:
    """Half away from zero, by scaling."""
    n = x.number()
    scale = F.lit(1.0) if digits is None else F.pow(F.lit(10.0), digits.number().try_cast("int").cast("double"))
    rounded = F.signum(n) * F.floor(F.abs(n) * scale + 0.5).cast("double") / scale
    return _num(F.when(F.isnan(n) | (F.abs(n) == float("inf")) | (F.abs(n) >= 9.0e15), n).otherwise(rounded))


def _substr(s: Value, start: Value, length: Value) -> Value:
    """Bytes from start (0-based, negative is 0) on, cut at the end; a negative length gives nothing."""
    raw = s.text().cast("binary")
    at, n = F.greatest(start.number().try_cast("int"), F.lit(0)), F.greatest(length.number().try_cast("int"), F.lit(0))
    return Value(F.when(at.isNull() | n.isNull(), None).otherwise(F.decode(F.substring(raw, at + 1, n), "UTF-8")))


def _replace(s: Value, old: Value, new: Value) -> Value:
    text, a, b = s.text(), F.coalesce(old.text(), F.lit("")), F.coalesce(new.text(), F.lit(""))
    spread = F.when(F.length(text) == 0, b).otherwise(F.concat(b, F.regexp_replace(text, F.lit("(?s)(.)"), F.concat(F.lit("$1"), F.regexp_replace(b, F.lit(r"([\\$])"), F.lit(r"\\$1"))))))
    return Value(F.when(a == "", spread).otherwise(F.replace(text, a, b)))


def _typeof(x: Value) -> Value:
    if x.numeric:
        return Value(F.when(x.column.isNull(), "missing").otherwise("number"))
    return Value(F.when(x.column.isNull(), "missing").when(x.number().isNotNull(), "number").otherwise("string"))


def _long(x: Value) -> Column:
    return x.number().try_cast("bigint")


def _bits(f: Callable[[Column, Column], Column]) -> Callable[..., Value]:
    return lambda a, b: _num(f(_long(a), _long(b)))


def _shift(f: Callable[[Column, Column], Column]) -> Callable[..., Value]:
    """Shifts by less than 0 or more than 63 give 0."""

    def shift(a: Value, b: Value) -> Value:
        x, n = _long(a), _long(b)
        inside = F.when((n < 0) | (n > 63), F.lit(0)).otherwise(f(x, n.cast("int")))
        return _num(F.when(x.isNull() | n.isNull(), None).otherwise(inside))

    return shift


def _coalesce(*xs: Value) -> Value:
    if all(x.numeric for x in xs):
        return _num(F.coalesce(*[x.column for x in xs]))
    return Value(F.coalesce(*[x.text() for x in xs]))


FUNCTIONS: dict[str, Callable[..., Value]] = {
    "tonumber": lambda x: _num(x.number()),
    "tostring": lambda x: Value(x.text()),
    "abs": _math(F.abs),
    "ceil": _math(lambda n: F.when(F.abs(n) < 9.0e15, F.ceil(n).cast("double")).otherwise(n)),
    "floor": _math(lambda n: F.when(F.abs(n) < 9.0e15, F.floor(n).cast("double")).otherwise(n)),
    "sqrt": _math(F.sqrt),
    "log": _log(F.log),
    "log10": _log(F.log10),
    "log2": _log(F.log2),
    "exp": _math(F.exp),
    "pow": lambda a, b: _num(F.pow(a.number(), b.number())),
    "round": _round,
    "len": lambda s: _num(F.octet_length(s.text())),
    "lower": lambda s: Value(F.lower(s.text())),
    "upper": lambda s: Value(F.upper(s.text())),
    "substr": _substr,
    "replace": _replace,
    "trim": lambda s: Value(F.regexp_replace(s.text(), r"(?U)\A\s+|\s+\z", "")),
    "concat": lambda *xs: Value(F.concat_ws("", *[x.text() for x in xs])),
    "coalesce": _coalesce,
    "isnull": lambda x: _num(x.column.isNull()),
    "typeof": _typeof,
    "bitor": _bits(lambda a, b: a.bitwiseOR(b)),
    "bitand": _bits(lambda a, b: a.bitwiseAND(b)),
    "bitxor": _bits(lambda a, b: a.bitwiseXOR(b)),
    "bitnot": lambda x: _num(F.bitwise_not(_long(x))),
    "bitshl": _shift(lambda x, n: F.call_function("shiftleft", x, n)),
    "bitshr": _shift(lambda x, n: F.call_function("shiftright", x, n)),
}


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """Double arithmetic; missing or non-numeric operands give missing, division and remainder by zero NaN."""
    x, y = a.number().cast("double"), b.number().cast("double")
    if op in "+-*":
        return _num({"+": x + y, "-": x - y, "*": x * y}[op])
    by_zero = F.when(x.isNotNull() & (y == 0), F.lit(NAN))
    return _num(by_zero.when(y != 0, x / y if op == "/" else x % y))
