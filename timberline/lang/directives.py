"""key=value directives of a search: bounds, order, limit; found outside quotes, before the first pipe."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import UTC, datetime, timedelta

from timberline.lang.errors import QueryError

NAMES = ("reverse", "start", "end", "last", "source_start", "source_end", "ingest_start", "ingest_end", "limit", "pos", "order")
_WORD = re.compile(r"(?i)(" + "|".join(NAMES) + r")=([^\s|()\"']+)(?=\s|\||$)")
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600, "d": 86400}


@dataclass(frozen=True)
class Directives:
    """Bounds are half-open: start included, end not."""

    start: datetime | None = None
    end: datetime | None = None
    source_start: datetime | None = None
    source_end: datetime | None = None
    reverse: bool = False
    limit: int | None = None
    pos: int | None = None
    order: str = "ingest_ts"


def duration(text: str) -> timedelta:
    """A sum of number-unit pairs, such as 1h30m, 500ms or 7d."""
    found = re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h|d)", text)
    if not found or "".join(n + u for n, u in found) != text:
        raise QueryError(f"bad duration {text!r}")
    return timedelta(seconds=sum(float(n) * _UNITS[u] for n, u in found))


def instant(text: str) -> datetime:
    """RFC 3339 or Unix seconds."""
    try:
        if re.fullmatch(r"-?\d+(\.\d+)?", text):
            return datetime.fromtimestamp(float(text), UTC)
        out = datetime.fromisoformat(text.replace("Z", "+00:00").replace("z", "+00:00"))
    except ValueError:
        raise QueryError(f"bad time {text!r}") from None
    if out.tzinfo is None:
        raise QueryError(f"time without a zone {text!r}")
    return out.astimezone(UTC)


def split(text: str, now: datetime | None = None) -> tuple[Directives, str]:
    """The directives of a query text, and the text without them (offsets stay)."""
    out, quote, i, d = list(text), "", 0, Directives()
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c == "|":
            break
        elif (i == 0 or text[i - 1] in " \t\r\n") and (m := _WORD.match(text, i)):
            d = _apply(d, m[1].lower(), m[2], now)
            out[i : m.end()] = " " * (m.end() - i)
            i = m.end()
            continue
        i += 1
    return d, "".join(out)


def _apply(d: Directives, name: str, value: str, now: datetime | None) -> Directives:
    if name == "reverse":
        if value.lower() not in ("true", "false", "1", "0"):
            raise QueryError(f"bad value of reverse: {value}")
        return replace(d, reverse=value.lower() in ("true", "1"))
    if name in ("limit", "pos"):
        if not value.isdigit():
            raise QueryError(f"bad value of {name}: {value}")
        return replace(d, **{name: int(value)})
    if name == "order":
        if value not in ("ingest_ts", "source_ts"):
            raise QueryError(f"bad value of order: {value}")
        return replace(d, order=value)
    if name == "last":
        if value.lower() == "all":
            return replace(d, start=None, end=None)
        now = now or datetime.now(UTC)
        return replace(d, start=now - duration(value), end=now)
    at = instant(value)
    return replace(d, **{name.removeprefix("ingest_"): at})
