"""Filters as boolean columns in which null stands for false; NOT makes that explicit.

A predicate on a key holds if any source of the key satisfies it: metadata, attributes, pairs
extracted from raw, JSON paths. Comparisons with promoted columns of their own type become
plain comparisons, which Spark pushes into the scan.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.functions import extract
from timberline.functions.values import parse_number
from timberline.lang import ast as A
from timberline.lang.directives import instant
from timberline.lang.errors import QueryError
from timberline.plans.expressions import compile_expression
from timberline.plans.frame import FIRST_CLASS, INSTANTS, Frame

_NUMBER = re.compile(r"(?i)[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?)|nan")
_TOKEN = re.compile(r"[A-Za-z0-9_-]{2,16}")
TOKEN_LENGTH = 16


def number_of(text: str) -> float | None:
    if not _NUMBER.fullmatch(text):
        return None
    out = float(text)
    return None if math.isinf(out) and any(c.isdigit() for c in text) else out


def glob_regex(glob: str) -> str:
    """An anchored, case-insensitive Java regex."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            close = glob.find("]", i + 2)
            body = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = close
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", c) if c.isascii() else c)
        i += 1
    return rf"(?isu)\A{''.join(out)}\z"


def indexable(token: str) -> bool:
    """Whether a query word stands for a whole token: 2 to 16 ASCII word bytes, not number-like."""
    if not _TOKEN.fullmatch(token):
        return False
    low = token.lower()
    if re.fullmatch(r"0x[0-9a-f]+|0o[0-7]+|0b[01]+", low):
        return False
    return not (re.fullmatch(r"[0-9a-f-]+", low) and re.search(r"[0-9a-f]", low))


def tokens(raw: Column) -> Column:
    """Indexed tokens of a message: lower-case, cut to 16 bytes, two or more, not number-like."""
    found = F.regexp_extract_all(raw, F.lit(r"[A-Za-z0-9_-]+"), F.lit(0))
    low = F.transform(found, lambda t: F.lower(F.left(t, F.lit(TOKEN_LENGTH))))
    numeric = r"\A(?:0x[0-9a-f]+|0o[0-7]+|0b[01]+|[0-9a-f-]*[0-9a-f][0-9a-f-]*)\z"
    return F.array_distinct(F.filter(low, lambda t: (F.length(t) >= 2) & ~t.rlike(numeric)))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _token(text: str, frame: Frame) -> Column:
    if not frame.has("raw"):
        return F.lit(False)
    raw = F.col("raw")
    if not indexable(text):
        return F.contains(F.lower(raw), F.lit(text.lower()))
    # the message's tokens are cut to 16 bytes, so a query of 16 matches any longer one
    tail = "" if len(text) == TOKEN_LENGTH else r"(?![A-Za-z0-9_-])"
    return raw.rlike(rf"(?i)(?<![A-Za-z0-9_-])\Q{text}\E{tail}")


def _ordered(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def compare_text(c: Column, op: str, value: str) -> Column:
    """Text against a literal: by number if the literal is one (others then fail), else any-case text order."""
    if op in ("=", "!="):
        return _ordered(op, F.lower(c), F.lit(value.lower()))
    n = number_of(value)
    if n is not None:
        return _ordered(op, parse_number(c), F.lit(n))
    return _ordered(op, F.lower(c), F.lit(value.lower()))


def _compare_typed(frame: Frame, column: str, op: str, value: str) -> Column:
    """A physical column against a literal, in the column's own type where that means the same."""
    if not frame.is_numeric(column):
        return compare_text(frame.column(column).text(), op, value)
    c, n = F.col(f"`{column}`"), number_of(value)
    if op in ("=", "!="):
        plain = n is not None and not math.isnan(n) and re.fullmatch(r"-?(0|[1-9]\d*)(\.\d*[1-9])?", value)
        if plain:
            exact = isinstance(frame.df.schema[column].dataType, T.IntegralType) and n == int(n)
            return _ordered(op, c, F.lit(int(n) if exact else n))
        return _ordered(op, F.lower(frame.column(column).text()), F.lit(value.lower()))
    if n is None:
        return _ordered(op, F.lower(frame.column(column).text()), F.lit(value.lower()))
    whole = isinstance(frame.df.schema[column].dataType, T.IntegralType) and math.isfinite(n) and n == int(n) and abs(n) < 2**62
    return _ordered(op, c, F.lit(int(n) if whole else n))


def _instant(column: str, kind: T.DataType, op: str, value: str) -> Column:
    """Instants: equality within the literal's precision; inequality never holds."""
    if op == "!=":
        return F.lit(False)
    try:
        at = instant(value)
    except QueryError:
        return F.lit(False)
    c, literal = F.col(column), lambda t: F.lit(t).cast("timestamp").cast(kind)
    if op != "=":
        return _ordered(op, c, literal(at))
    digits = len(m[1]) if (m := re.search(r"\.(\d+)", value)) else 0
    step = timedelta(seconds=1) if digits == 0 else timedelta(milliseconds=1) if digits <= 3 else timedelta(microseconds=1)
    floor = at - (at - datetime(1970, 1, 1, tzinfo=at.tzinfo)) % step
    return (c >= literal(floor)) & (c < literal(floor + step))


def _any_pair(frame: Frame, test: Callable[[Column, Column], Column], paths: bool = True) -> list[Column]:
    """Attribute entries and extracted pairs that pass test(key, value)."""
    out = []
    if frame.has("attrs"):
        out.append(F.exists(F.map_entries("attrs"), lambda e: test(F.lower(e["key"]), e["value"])))
    if frame.has("pairs"):
        last = extract.PATH if not paths else extract.PATH + 1
        out.append(F.exists("pairs", lambda p: (p["s"] < last) & test(F.lower(p["k"]), p["v"])))
    return out


def _compare(f: A.Compare, frame: Frame) -> Column:
    key, value = f.key, f.value
    open_ = frame.records and not frame.closed
    if isinstance(key, str) and key.lower() in FIRST_CLASS and open_ and frame.has(key.lower()) and key not in frame.fields:
        return _first_class(key.lower(), f, frame)
    mine = [(n, c) for n, c in frame.fields.items() if _key_fits(key, n)]
    key_test = _key_test(key)

    def on(test_column: Callable[[str], Column], test_text: Callable[[Column], Column], paths: bool = True) -> Column:
        found = [test_column(c) for _, c in mine]
        if open_:
            hide = [h.lower() for h in frame.hidden]
            free = lambda k: key_test(k) & ~k.isin(hide) if hide else key_test(k)
            found += _any_pair(frame, lambda k, v: free(k) & test_text(v), paths)
        if not found:
            return F.lit(False)
        out = found[0]
        for c in found[1:]:
            out = out | c
        return out

    if value is None:
        return on(lambda c: F.col(f"`{c}`").isNotNull(), lambda v: F.lit(True))
    if isinstance(value, A.Glob):
        pattern = glob_regex(value.text)
        return on(lambda c: frame.column(c).text().rlike(pattern), lambda v: v.rlike(pattern), key is not None)
    return on(lambda c: _compare_typed(frame, c, f.op, value), lambda v: compare_text(v, f.op, value), key is not None)


def _key_fits(key: str | A.Glob | None, name: str) -> bool:
    if key is None:
        return True
    if isinstance(key, A.Glob):
        return re.fullmatch(glob_regex(key.text).replace("(?isu)", "(?is)").replace(r"\z", r"\Z"), name) is not None
    return key.lower() == name.lower()


def _key_test(key: str | A.Glob | None) -> Callable[[Column], Column]:
    if key is None:
        return lambda k: F.lit(True)
    if isinstance(key, A.Glob):
        return lambda k: k.rlike(glob_regex(key.text))
    return lambda k: k == key.lower()


def _first_class(name: str, f: A.Compare, frame: Frame) -> Column:
    c = F.col(name)
    if f.value is None:
        here = c.isNotNull()
    elif isinstance(f.value, A.Glob):
        here = frame.column(name).text().rlike(glob_regex(f.value.text))
    elif name in INSTANTS:
        here = _instant(name, frame.df.schema[name].dataType, f.op, f.value)
    else:
        here = _compare_typed(frame, name, f.op, f.value)
    rest = _any_pair(frame, lambda k, v: (k == name) & (F.lit(True) if f.value is None else v.rlike(glob_regex(f.value.text)) if isinstance(f.value, A.Glob) else compare_text(v, f.op, f.value)))
    if not rest:
        return here
    other = rest[0] if len(rest) == 1 else rest[0] | rest[1]
    return F.when(c.isNotNull(), here).otherwise(other)


def compile_filter(f: object, frame: Frame) -> Column:
    match f:
        case None | A.MatchAll():
            return F.lit(True)
        case A.Token(t):
            return _token(t, frame) if frame.records else F.lit(False)
        case A.BareGlob(g):
            if not (frame.records and frame.has("raw")):
                return F.lit(False)
            words = F.concat(tokens(F.col("raw")), F.split("raw", r"[ \t\n\r]+"))
            found = F.exists(words, lambda w: w.rlike(glob_regex(g.text)))
            # messages without the glob's longest literal part need not be cut into words
            part = max(re.split(r"[*?]|\[[^\]]*\]", g.text), key=len)
            return F.col("raw").rlike(rf"(?isu)\Q{part}\E") & found if part else found
        case A.Regex(p):
            return F.col("raw").rlike(f"(?i){p}") if frame.records and frame.has("raw") else F.lit(False)
        case A.Compare():
            return _compare(f, frame)
        case A.ExprCompare(left, op, value):
            found = compile_expression(left, frame)
            if not found.numeric:
                return compare_text(found.text(), op, value)
            n = number_of(value)
            if n is not None and op not in ("=", "!="):
                return _ordered(op, found.column, F.lit(n))
            return compare_text(found.text(), op, value)
        case A.Not(t):
            return ~_sure(compile_filter(t, frame))
        case A.And(ts):
            out = compile_filter(ts[0], frame)
            for t in ts[1:]:
                out = out & compile_filter(t, frame)
            return out
        case A.Or(ts):
            out = compile_filter(ts[0], frame)
            for t in ts[1:]:
                out = out | compile_filter(t, frame)
            return out
    raise TypeError(f)


def keys_of(f: object) -> set[str] | None:
    """Field names a filter may read; None if it may read any (globs, any-key)."""
    match f:
        case A.Compare(k, _, _):
            return {k} if isinstance(k, str) else None
        case A.ExprCompare(left, _, _):
            from timberline.plans.expressions import fields_of

            return fields_of(left)
        case A.Not(t):
            return keys_of(t)
        case A.And(ts) | A.Or(ts):
            out: set[str] = set()
            for t in ts:
                found = keys_of(t)
                if found is None:
                    return None
                out |= found
            return out
    return set()
