"""Recursive-descent parser: text to ``Query``."""

from __future__ import annotations

import re

from timberline.lang import ast as A
from timberline.lang.errors import QueryError
from timberline.lang.lexer import Lexeme, Lexer, strip_comments

SCALARS = {
    "tonumber": (1, 1), "tostring": (1, 1), "abs": (1, 1), "ceil": (1, 1), "floor": (1, 1), "sqrt": (1, 1), "log": (1, 1), "log10": (1, 1), "log2": (1, 1),
    "exp": (1, 1), "pow": (2, 2), "round": (1, 2), "len": (1, 1), "lower": (1, 1), "upper": (1, 1), "substr": (3, 3), "replace": (3, 3), "trim": (1, 1),
    "concat": (1, None), "coalesce": (1, None), "isnull": (1, 1), "typeof": (1, 1), "bitor": (2, 2), "bitand": (2, 2), "bitxor": (2, 2), "bitnot": (1, 1),
    "bitshl": (2, 2), "bitshr": (2, 2),
}
AGGREGATES = ("count", "sum", "avg", "min", "max", "dcount", "median", "first", "last", "values")
CHARTS = {"linechart": 0, "barchart": 0, "donut": 0, "heatmap": 0, "scatter": 2}
MAPS = {"choropleth": 1, "scatter": 2}
COMPARE = ("=", "!=", ">=", "<=", ">", "<")
MAX_LENGTH = 4096
_NUMBER = re.compile(r"\d+\.?\d*|\.\d+")
_DURATION = re.compile(r"(?:\d+\.?\d*|\.\d+)[smhd]")


class Parser:
    def __init__(self, text: str) -> None:
        if len(text.encode()) > MAX_LENGTH:
            raise QueryError(f"query longer than {MAX_LENGTH} bytes")
        self.lexer = Lexer(strip_comments(text))
        self.now = self.lexer.next()

    # --- plumbing ---

    def _advance(self) -> Lexeme:
        old, self.now = self.now, self.lexer.next()
        return old

    def _mode(self, pipe: bool) -> None:
        """Switch modes and read the current lexeme again."""
        if self.lexer.pipe != pipe:
            self.lexer.pipe, self.lexer.at = pipe, self.now.at
            self.now = self.lexer.next()

    def _expect(self, kind: str) -> Lexeme:
        if self.now.kind != kind:
            raise QueryError(f"expected {kind!r}, found {self.now.text or 'the end'!r}", self.now.at)
        return self._advance()

    def _is(self, word: str, case: bool = False) -> bool:
        return self.now.kind == "word" and not self.now.quoted and (self.now.text if case else self.now.text.lower()) == word

    def _name(self) -> str:
        return self._expect("word").text

    def _names(self) -> list[str]:
        out = [self._name()]
        while self.now.kind == ",":
            self._advance()
            out.append(self._name())
        return out

    def _count(self, least: int) -> int:
        found = self._expect("word")
        if not found.text.isdigit() or int(found.text) < least:
            raise QueryError(f"expected a whole number of at least {least}", found.at)
        return int(found.text)

    # --- filters ---

    def query(self) -> A.Query:
        where = None
        if self.now.kind == "end":
            raise QueryError("empty query", self.now.at)
        if self.now.kind != "|":
            where = self._or()
        pipes = []
        while self.now.kind == "|":
            self._mode(True)
            self.lexer.pipe, self.lexer.at = True, self.now.end
            self.now = self.lexer.next()
            pipes.append(self._pipe())
        if self.now.kind != "end":
            raise QueryError(f"unexpected {self.now.text!r}", self.now.at)
        return A.Query(where, tuple(pipes))

    def filter_only(self) -> object:
        out = self._or()
        if self.now.kind != "end":
            raise QueryError(f"unexpected {self.now.text!r}", self.now.at)
        return out

    def _or(self) -> object:
        terms = [self._and()]
        while self.now.keyword() == "OR":
            self._advance()
            terms.append(self._and())
        return terms[0] if len(terms) == 1 else A.Or(tuple(terms))

    def _and(self) -> object:
        terms = [self._not()]
        while True:
            if self.now.keyword() == "AND":
                self._advance()
            elif self.now.keyword() == "OR" or self.now.kind in ("end", "|", ")"):
                break
            terms.append(self._not())
        return terms[0] if len(terms) == 1 else A.And(tuple(terms))

    def _not(self) -> object:
        if self.now.keyword() == "NOT":
            self._advance()
            return A.Not(self._not())
        if self.now.kind == "(":
            opened = self._advance()
            inside = self._or()
            if self.now.kind != ")":
                raise QueryError("unmatched (", opened.at)
            self._advance()
            return inside
        return self._predicate()

    def _predicate(self) -> object:
        start = self.now
        if start.kind == "regex":
            try:
                re.compile(start.text)
            except re.error as e:
                raise QueryError(f"bad regex: {e}", start.at) from None
            if re.search(r"\(\?(?:[=!<]|P=|>)|\\[1-9]", start.text):
                raise QueryError("look-around and back references are not supported", start.at)
            self._advance()
            return A.Regex(start.text)
        if start.kind not in ("word", "glob", "*") or start.keyword():
            raise QueryError(f"unexpected {start.text or 'end of query'!r}", start.at)
        if start.kind == "word" and not start.quoted and start.text.lower() in SCALARS and self.lexer.text[start.end : start.end + 1] == "(":
            return self._expression_predicate()
        self._advance()
        if self.now.kind not in COMPARE:
            if start.kind == "*":
                return A.MatchAll()
            return A.BareGlob(A.Glob(start.text)) if start.kind == "glob" else A.Token(start.text)
        op = self._advance().kind
        value = self.now
        if value.kind not in ("word", "glob", "*"):
            raise QueryError("expected a value", value.at)
        self._advance()
        if op != "=" and ("*" in (start.kind, value.kind) or "glob" in (start.kind, value.kind)):
            raise QueryError(f"{op} takes neither * nor globs", start.at)
        if start.kind == value.kind == "*":
            raise QueryError("*=* is not a predicate", start.at)

        def side(x: Lexeme) -> str | A.Glob | None:
            return None if x.kind == "*" else A.Glob(x.text) if x.kind == "glob" else x.text

        return A.Compare(side(start), op, side(value))

    def _expression_predicate(self) -> object:
        self._mode(True)
        left = self._sum()
        op = self.now
        if op.kind not in COMPARE:
            raise QueryError("expected a comparison after an expression", op.at)
        self.lexer.pipe, self.lexer.at = False, op.end
        self.now = self.lexer.next()
        value = self.now.text
        if self.now.kind != "word":
            raise QueryError("expected a literal", self.now.at)
        self._advance()
        return A.ExprCompare(left, op.kind, value)

    # --- expressions (pipe mode) ---

    def _sum(self) -> object:
        out = self._product()
        while self.now.kind in ("+", "-"):
            out = A.Binary(self._advance().kind, out, self._product())
        return out

    def _product(self) -> object:
        out = self._unary()
        while self.now.kind in ("*", "/", "%"):
            out = A.Binary(self._advance().kind, out, self._unary())
        return out

    def _unary(self) -> object:
        if self.now.kind == "-":
            self._advance()
            return A.Negate(self._unary())
        return self._primary()

    def _primary(self) -> object:
        if self.now.kind == "(":
            self._advance()
            out = self._sum()
            self._expect(")")
            return out
        word = self._expect("word")
        if word.quoted:
            return A.Text(word.text)
        if _NUMBER.fullmatch(word.text):
            return A.Number(float(word.text), word.text)
        if self.now.kind != "(":
            return A.Field(word.text)
        return self._call(word)

    def _call(self, word: Lexeme) -> A.Call:
        name = word.text.lower()
        if name not in SCALARS:
            raise QueryError(f"unknown function {word.text}", word.at)
        self._expect("(")
        args = []
        if self.now.kind != ")":
            args.append(self._sum())
            while self.now.kind == ",":
                self._advance()
                args.append(self._sum())
        self._expect(")")
        low, high = SCALARS[name]
        if len(args) < low or (high is not None and len(args) > high):
            raise QueryError(f"{name} takes {low if low == high else f'{low} or more' if high is None else f'{low} to {high}'} arguments", word.at)
        return A.Call(name, tuple(args))

    # --- pipes ---

    def _pipe(self) -> object:
        word = self._expect("word")
        name = word.text.lower()
        found = getattr(self, f"_pipe_{name}", None)
        if name in CHARTS:
            return A.Chart(name, tuple(self._name() for _ in range(CHARTS[name])))
        if found is None or word.quoted:
            raise QueryError(f"unknown operator {word.text}", word.at)
        return found()

    def _pipe_where(self) -> object:
        self._mode(False)
        out = A.Where(self._or())
        self._mode(True)
        return out

    def _pipe_eval(self) -> object:
        out = []
        while True:
            name = self._name()
            self._expect("=")
            out.append((name, self._sum()))
            if self.now.kind != ",":
                return A.Eval(tuple(out))
            self._advance()

    def _pipe_sort(self) -> object:
        keys = []
        while True:
            down = self.now.kind == "-"
            if down:
                self._advance()
            keys.append(A.SortKey(self._name(), down))
            if self.now.kind != ",":
                return A.Sort(tuple(keys))
            self._advance()

    def _pipe_head(self) -> object:
        return A.Head(self._count(1))

    def _pipe_tail(self) -> object:
        return A.Tail(self._count(1))

    def _pipe_slice(self) -> object:
        at = self.now.at
        first, last = self._count(1), self._count(1)
        if last < first:
            raise QueryError("slice ends before it starts", at)
        return A.Slice(first, last)

    def _pipe_rename(self) -> object:
        pairs = []
        while True:
            old = self._name()
            if not self._is("as"):
                raise QueryError("expected 'as'", self.now.at)
            self._advance()
            pairs.append((old, self._name()))
            if self.now.kind != ",":
                return A.Rename(tuple(pairs))
            self._advance()

    def _pipe_fields(self) -> object:
        drop = self.now.kind == "-"
        if drop:
            self._advance()
        return A.Fields(tuple(self._names()), drop)

    def _pipe_dedup(self) -> object:
        return A.Dedup(self._advance().text if self.now.kind == "word" else None)

    def _pipe_lookup(self) -> object:
        table, fields = self._name(), [self._name()]
        while self.now.kind == "word":
            fields.append(self._name())
        return A.Lookup(table, tuple(fields))

    def _pipe_raw(self) -> object:
        return A.Raw()

    def _pipe_map(self) -> object:
        kind = self._expect("word")
        if kind.text.lower() not in MAPS:
            raise QueryError("map is choropleth or scatter", kind.at)
        columns = tuple(self._name() for _ in range(MAPS[kind.text.lower()]))
        return A.Chart("choropleth" if len(columns) == 1 else "points", columns)

    def _pipe_export(self) -> object:
        return A.Export(self._name())

    def _pipe_timechart(self) -> object:
        n = self._count(0) if self.now.kind == "word" and self.now.text.isdigit() else 0
        by = None
        if self._is("by", case=True):
            self._advance()
            by = self._name()
        return A.Timechart(n, by)

    def _pipe_stats(self) -> object:
        aggregates, at = [self._aggregate()], self.now.at
        while self.now.kind == ",":
            self._advance()
            aggregates.append(self._aggregate())
        groups = []
        if self._is("by"):
            self._advance()
            groups.append(self._group())
            while self.now.kind == ",":
                self._advance()
                groups.append(self._group())
        aliases = [a.alias for a in aggregates]
        if len(set(aliases)) < len(aliases):
            raise QueryError("two aggregates have one name", at)
        if sum(isinstance(g, A.Bin) for g in groups) > 1:
            raise QueryError("at most one bin()", at)
        return A.Stats(tuple(aggregates), tuple(groups))

    def _aggregate(self) -> A.Aggregate:
        word = self._expect("word")
        func, arg = word.text.lower(), None
        if func not in AGGREGATES:
            raise QueryError(f"unknown aggregate {word.text}", word.at)
        if self.now.kind == "(":
            self._advance()
            if self.now.kind != ")":
                arg = self._sum()
            self._expect(")")
        if arg is None and func != "count":
            raise QueryError(f"{func} needs an argument", word.at)
        alias = f"{func}_{arg.name}" if isinstance(arg, A.Field) else func
        if self._is("as"):
            self._advance()
            alias = self._name()
        return A.Aggregate(func, arg, alias)

    def _group(self) -> str | A.Bin:
        word = self._expect("word")
        if word.text.lower() != "bin" or word.quoted or self.now.kind != "(":
            return word.text
        self._advance()
        duration = self._expect("word")
        if not _DURATION.fullmatch(duration.text) or float(duration.text[:-1]) <= 0:
            raise QueryError("bad bin duration", duration.at)
        field = None
        if self.now.kind == ",":
            self._advance()
            field = self._name()
        self._expect(")")
        return A.Bin(duration.text, field)


def check(query: A.Query) -> A.Query:
    """Structural rules: one aggregation, one chart, what may follow what."""
    aggregated = charted = False
    for i, op in enumerate(query.pipes):
        if isinstance(op, (A.Stats, A.Timechart)):
            if aggregated:
                raise QueryError("only one stats or timechart")
            aggregated = True
        elif isinstance(op, A.Chart):
            if charted:
                raise QueryError("only one chart")
            charted = True
        elif isinstance(op, A.Export) and i < len(query.pipes) - 1:
            raise QueryError("export must be last")
        if aggregated and isinstance(op, (A.Dedup, A.Export)):
            raise QueryError(f"{type(op).__name__.lower()} works on records, not on an aggregation")
    return query


def parse(text: str) -> A.Query:
    return check(Parser(text).query())


def parse_filter(text: str) -> object:
    return Parser(text).filter_only()
