"""Tokens of query text, in filter mode or pipe mode."""

from __future__ import annotations

from dataclasses import dataclass

from timberline.lang.errors import QueryError

BREAKS = set(" \t\r\n()=*?[\"'/><!|,+%#")
ESCAPES = {"\\": "\\", '"': '"', "'": "'", "n": "\n", "t": "\t", "r": "\r"}


@dataclass(frozen=True)
class Lexeme:
    kind: str  # word glob regex end or the operator itself
    text: str
    at: int
    quoted: bool = False
    end: int = 0

    def keyword(self) -> str | None:
        upper = self.text.upper()
        return upper if self.kind == "word" and not self.quoted and upper in ("AND", "OR", "NOT") else None


def strip_comments(text: str) -> str:
    """Blank out # comments up to the end of their line, outside quotes and regex literals; offsets stay."""
    out, i, quote = list(text), 0, ""
    regex_ok = True
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c == "/" and regex_ok and "/" in text[i + 1 :].split("\n", 1)[0] and not text[:i].rstrip().endswith((")",)):
            quote = "/"
        elif c == "#":
            while i < len(text) and text[i] != "\n":
                out[i] = " "
                i += 1
            continue
        elif c == "|":
            regex_ok = text[i + 1 :].lstrip()[:5].lower() == "where"
        i += 1
    return "".join(out)


class Lexer:
    """Reads one lexeme at a time; ``pipe`` switches / and - to operators."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.pipe = text, 0, False

    def next(self) -> Lexeme:
        text = self.text
        while self.at < len(text) and text[self.at] in " \t\r\n":
            self.at += 1
        start = self.at
        if start >= len(text):
            return Lexeme("end", "", start, end=start)
        c = text[start]
        if c in "\"'":
            return self._quoted(c)
        if c == "/" and not self.pipe:
            return self._regex()
        two = text[start : start + 2]
        if two in ("!=", ">=", "<="):
            return self._take(two, 2)
        if c in "()=<>|,+%/":
            return self._take(c, 1)
        if c == "*" and (self.pipe or not self._word_follows(start + 1)):
            return self._take("*", 1)
        if c == "-" and self.pipe:
            return self._take("-", 1)
        if c in "!#":
            raise QueryError(f"unexpected {c!r}", start)
        return self._word()

    def _take(self, kind: str, n: int) -> Lexeme:
        start, self.at = self.at, self.at + n
        return Lexeme(kind, kind, start, end=self.at)

    def _word_follows(self, at: int) -> bool:
        return at < len(self.text) and (self.text[at] not in BREAKS or self.text[at] in "?[")

    def _quoted(self, quote: str) -> Lexeme:
        start, out = self.at, []
        i = start + 1
        while i < len(self.text):
            c = self.text[i]
            if c == quote:
                self.at = i + 1
                return Lexeme("word", "".join(out), start, True, self.at)
            if c == "\\":
                i += 1
                if i >= len(self.text) or self.text[i] not in ESCAPES:
                    raise QueryError("unknown escape", i)
                c = ESCAPES[self.text[i]]
            out.append(c)
            i += 1
        raise QueryError("unterminated string", start)

    def _regex(self) -> Lexeme:
        start, out = self.at, []
        i = start + 1
        while i < len(self.text):
            c = self.text[i]
            if c == "/":
                self.at = i + 1
                return Lexeme("regex", "".join(out), start, end=self.at)
            if c == "\\" and self.text[i + 1 : i + 2] == "/":
                out.append("/")
                i += 2
                continue
            if c == "\\":
                out.append(self.text[i : i + 2])
                i += 2
                continue
            out.append(c)
            i += 1
        raise QueryError("unterminated regex", start)

    def _word(self) -> Lexeme:
        start, i, glob, text = self.at, self.at, False, self.text
        while i < len(text):
            c = text[i]
            if not self.pipe and c in "*?":
                glob = True
                i += 1
            elif not self.pipe and c == "[":
                close = text.find("]", i + 2)
                if close < 0:
                    raise QueryError("unterminated [ in glob", i)
                glob, i = True, close + 1
            elif c in BREAKS:
                break
            else:
                i += 1
        if i == start:
            raise QueryError(f"unexpected {text[start]!r}", start)
        self.at = i
        return Lexeme("glob" if glob else "word", text[start:i], start, end=i)
