"""Dynamically typed values as columns: text that may read as a number, numbers, and null for missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = r"(?i)\A(?:[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?)|nan)\z"


@dataclass(frozen=True)
class Value:
    """A column and whether it holds numbers or text."""

    column: Column
    numeric: bool = False

    def number(self) -> Column:
        return self.column if self.numeric else parse_number(self.column)

    def text(self) -> Column:
        return render_number(self.column) if self.numeric else self.column


def missing() -> Value:
    return Value(F.lit(None).cast("string"))


def parse_number(text: Column) -> Column:
    """Text as a double, null where it isn't a number; what overflows isn't one."""
    n = text.try_cast("double")
    overflow = (F.abs(n) == float("inf")) & text.rlike(r"\d")
    return F.when(text.rlike(NUMERIC) & ~overflow, n)


def render_number(n: Column) -> Column:
    """Shortest decimal text without exponent: 3, 0.1, 10000000; NaN, +Inf, -Inf."""
    d = n.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < 9.2e18)
    plain = d.cast("string")
    wide = F.regexp_replace(F.regexp_replace(plain.try_cast("decimal(38,18)").cast("string"), r"0+\z", ""), r"\.\z", "")
    return (
        F.when(d.isNull(), None)
        .when(F.isnan(d), "NaN")
        .when(d == float("inf"), "+Inf")
        .when(d == float("-inf"), "-Inf")
        .when(whole, F.when((d == 0) & plain.startswith("-"), "-0").otherwise(d.try_cast("bigint").cast("string")))
        .when(plain.contains("E"), F.coalesce(wide, plain))
        .otherwise(plain)
    )


def double(c: Column) -> Column:
    return c.cast("double")
