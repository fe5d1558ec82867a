"""Schema-on-read: key=value pairs, logfmt, access logs and JSON inside raw messages.

``pairs_of`` is plain Python over one message; ``pairs`` runs it over Arrow batches as one
UDF that Spark evaluates once a row, and only in queries whose fields need it.
``flat_json_pairs`` is the JVM-only form for messages that are one-level JSON objects.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SIDE = 64
MAX_DEPTH = 4
MAX_PATH = 256
KV, JSON, PATH = 0, 1, 2
PAIR = "array<struct<k:string,v:string,s:tinyint>>"

_KV = re.compile(
    r"""(?:(?<=^)|(?<=[\s,;:()\[\]{}]))                 # where a key may begin
        ([A-Za-z0-9_.]+)=
        (?:"([^"]*)"|'([^']*)'|([^\s,;)\]}]*))""",
    re.VERBOSE | re.ASCII,
)
_KEY = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*", re.ASCII)
_UNFIT = re.compile(r"""[^\x00-\x7f]|[{}\[\]"'=&]""")
_LOGFMT_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_\-.:/]*")
_ACCESS = re.compile(r'^(\S+) \S+ (\S+) \[[^\]]*\] "(\S+) (\S+)(?: (\S+))?" (\d{3}) (\d+|-)(?: "([^"]*)" "([^"]*)")?')
_ACCESS_NAMES = ("remote_host", "remote_user", "method", "path", "protocol", "status", "body_bytes", "referer", "user_agent")
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _low(text: str) -> str:
    return text.translate(_ASCII_LOWER)


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def key_values(raw: str) -> list[tuple[str, str]]:
    """key=value anywhere in a message; keys are dotted identifiers behind a delimiter."""
    out = []
    for m in _KV.finditer(raw):
        value = next((g for g in m.groups()[1:] if g is not None), "")
        if _KEY.fullmatch(m[1]) and len(m[1]) <= MAX_SIDE and value and _size(value) <= MAX_SIDE and not _UNFIT.search(value):
            out.append((_low(m[1]), _low(value)))
    return out


def logfmt(raw: str) -> list[tuple[str, str]]:
    """key=value, key="quoted value" and bare keys (true), for lines that look like logfmt."""
    if "=" not in raw or raw.lstrip(" \t\r\n")[:1] in ("{", "[", "<"):
        return []
    out, i, n = [], 0, len(raw)
    while i < n:
        while i < n and raw[i] <= " ":
            i += 1
        start = i
        while i < n and raw[i] > " " and raw[i] not in '="':
            i += 1
        key = raw[start:i]
        if not key or not _LOGFMT_KEY.fullmatch(key) or len(key) > MAX_SIDE:
            while i < n and raw[i] > " ":
                i += 1
            continue
        if i >= n or raw[i] != "=":
            out.append((_low(key), "true"))
            continue
        i += 1
        if i >= n or raw[i] <= " ":
            continue
        if raw[i] == '"':
            i += 1
            text = []
            while i < n and raw[i] != '"':
                if raw[i] == "\\" and raw[i + 1 : i + 2] in ('"', "\\"):
                    i += 1
                text.append(raw[i])
                i += 1
            i += 1
            value = "".join(text)
        else:
            start = i
            while i < n and raw[i] > " " and raw[i] not in '="':
                i += 1
            value = raw[start:i]
        if value and _size(value) <= MAX_SIDE:
            out.append((_low(key), _low(value)))
    return out


def access_log(raw: str) -> list[tuple[str, str]]:
    """Fields of a common or combined log line."""
    m = _ACCESS.match(raw)
    if not m:
        return []
    out = []
    for name, value in zip(_ACCESS_NAMES, m.groups()):
        if value and value != "-" and _size(value) <= MAX_SIDE and not (name == "body_bytes" and value == "0"):
            out.append((name, _low(value)))
    return out


def _scalar(x: object) -> str | None:
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        if float(x).is_integer() and abs(x) < 2**63:
            return str(int(x))
        return format(float(x), "f").rstrip("0") if abs(float(x)) >= 1e16 else _plain(float(x))
    return x if isinstance(x, str) and x else None


def _plain(x: float) -> str:
    text = repr(x)
    return text if "e" not in text else format(x, ".20f").rstrip("0")


def json_object(raw: str) -> dict | None:
    if raw.lstrip(" \t\r\n")[:1] != "{":
        return None
    try:
        found = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def json_flat(obj: dict) -> list[tuple[str, str]]:
    """Scalars under dotted keys, arrays of scalars under the array's key."""
    out: list[tuple[str, str]] = []

    def walk(prefix: str, at: dict, depth: int) -> None:
        if depth >= MAX_DEPTH:
            return
        for k, v in at.items():
            key = f"{prefix}.{k}" if prefix else k
            if _size(key) > MAX_SIDE:
                continue
            if isinstance(v, dict):
                walk(key, v, depth + 1)
                continue
            if isinstance(v, list) and depth + 1 >= MAX_DEPTH:
                continue
            for x in v if isinstance(v, list) else [v]:
                text = _scalar(x)
                if text is not None and _size(text) <= MAX_SIDE:
                    out.append((_low(key), _low(text)))

    walk("", obj, 0)
    return out


def json_paths(obj: dict) -> list[tuple[str, str | None]]:
    """Every path of the document, arrays as [*], with the leaf's text or null."""
    out: list[tuple[str, str | None]] = []

    def walk(path: str, x: object) -> None:
        if len(path) > MAX_PATH:
            return
        if path:
            text = _scalar(x)
            out.append((_low(path), _low(text) if text is not None and _size(text) <= MAX_SIDE else None))
        if isinstance(x, dict):
            for k, v in x.items():
                walk(f"{path}.{k}" if path else k, v)
        elif isinstance(x, list):
            for v in x:
                walk(f"{path}.[*]", v)

    walk("", obj)
    return out


def pairs_of(raw: str | None) -> list[tuple[str, str | None, int]]:
    """All pairs of a message in order of precedence, later ones win: text forms, JSON; then JSON paths."""
    if not raw:
        return []
    obj = json_object(raw)
    found = [(k, v, KV) for k, v in [*key_values(raw), *logfmt(raw), *access_log(raw)]]
    if obj is not None:
        found += [(k, v, JSON) for k, v in json_flat(obj)] + [(k, v, PATH) for k, v in json_paths(obj)]
    return list(dict.fromkeys(found))


#: a batch is worked through in pieces of so many messages, or as many bytes if that's fewer messages
PIECE_ROWS, PIECE_BYTES = 256, 1 << 18


def _pieces(messages: pa.Array) -> Iterator[pa.Array]:
    """Slices of a batch's messages, one at least, by number and by bytes."""
    sizes = pc.fill_null(pc.binary_length(messages), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= PIECE_ROWS or held + n > PIECE_BYTES):
            yield messages.slice(start, i - start)
            start, held = i, 0
        held += n
    yield messages.slice(start)


def _pairs_array(messages: pa.Array) -> pa.Array:
    """``pairs_of`` of some messages as Arrow lists, from flat columns instead of a dict a pair."""
    offsets, keys, values, kinds = [0], [], [], []
    for m in messages.to_pylist():
        for k, v, s in pairs_of(m):
            keys.append(k)
            values.append(v)
            kinds.append(s)
        offsets.append(len(keys))
    fields = [pa.array(keys, pa.string()), pa.array(values, pa.string()), pa.array(kinds, pa.int8())]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["k", "v", "s"]))


def pairs(raw: Column) -> Column:
    """``pairs_of`` over a column, as array<struct<k, v, s>>; a batch's Python objects live for a piece of it only."""

    @F.arrow_udf(PAIR)
    def run(messages: pa.Array) -> pa.Array:
        return pa.concat_arrays([_pairs_array(p) for p in _pieces(messages)])

    return run(raw)


def flat_json_pairs(raw: Column) -> Column:
    """The JSON pairs of one-level objects, without leaving the JVM."""
    entries = F.map_entries(F.from_json(raw, "map<string,string>"))
    fit = F.filter(entries, lambda e: e["value"].isNotNull() & (F.octet_length(e["value"]) <= MAX_SIDE) & (F.octet_length(e["key"]) <= MAX_SIDE) & (e["value"] != "") & ~e["value"].rlike(r"^[\[{]"))
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(fit, lambda e: F.struct(low(e["key"]).alias("k"), low(e["value"]).alias("v"), F.lit(JSON).cast("tinyint").alias("s")))
