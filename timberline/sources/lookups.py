"""Lookup tables from files, lists and services, for the ``lookup`` operator.

Services are functions of the distinct values of an Arrow batch. They have a client, a time limit and a memory
of their own; tests and deployments can hand in others.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache
from string import Formatter
from typing import ClassVar
from urllib.parse import quote

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from timberline.operators.lookup import Function, Lookup, Ranges, Table

AGENT = ("browser", "browser_version", "os", "os_version", "device", "device_type")


def csv_table(spark: SparkSession, path: str, key: str | None = None, values: Iterable[str] = (), delimiter: str = ",") -> Table:
    """A CSV file with a header; the key is its first column unless named, values all others."""
    df = spark.read.option("header", True).option("sep", delimiter).csv(path)
    key = key or df.columns[0]
    values = tuple(values) or tuple(c for c in df.columns if c != key)
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    return Table(placed, (key,), values, order=("__file", "__block"))


def json_table(spark: SparkSession, path: str, key: str, values: Iterable[str] = (), multi_line: bool = True, rows: str | None = None, columns: dict[str, str] | None = None) -> Table:
    """A JSON array of objects (or one object a line); nested values become JSON text.

    ``rows`` is SQL for the array of rows inside each object (say ``data.hosts``), ``columns`` SQL for each
    column of a row: together they turn a document into rows.
    """
    df = spark.read.option("multiLine", multi_line).json(path)
    if rows:
        df = df.select(F.explode(F.expr(rows)).alias("row")).select("row.*")
    if columns:
        df = df.select(*[F.expr(e).alias(n) for n, e in columns.items()])
    plain = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes]
    return Table(df.select(*plain), (key,), tuple(values) or tuple(c for c in df.columns if c != key))


def yaml_table(spark: SparkSession, text: str, key: str) -> Table:
    """A YAML list of flat maps (needs a YAML parser on the driver)."""
    import yaml

    return static_table(spark, [{k: v if isinstance(v, str) else json.dumps(v) for k, v in row.items()} for row in yaml.safe_load(text)], (key,))


def static_table(spark: SparkSession, rows: list[dict[str, str]], keys: tuple[str, ...]) -> Table:
    """Rows given in place; of equal keys the first counts."""
    names = [*keys, *dict.fromkeys(k for row in rows for k in row if k not in keys)]
    data = [tuple(None if row.get(n) is None else str(row[n]) for n in names) for row in rows]
    df = spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names)).coalesce(1)
    return Table(df, keys, tuple(n for n in names if n not in keys))


def geo_ranges(spark: SparkSession, path: str, values: Iterable[str]) -> Ranges:
    """A CSV of lo, hi (addresses as whole numbers) and values such as country or asn."""
    return Ranges(spark.read.option("header", True).csv(path), "lo", "hi", tuple(values))


def _several(columns: tuple[pd.Series, ...], f: Callable[..., dict[str, str] | None], names: tuple[str, ...]) -> pd.DataFrame:
    """f once per distinct tuple of values; tuples with a null give null rows."""
    keys = list(zip(*columns))
    found = {k: f(*k) or {} for k in set(keys) if all(isinstance(v, str) and v for v in k)}
    return pd.DataFrame([[found.get(k, {}).get(n) for n in names] for k in keys], columns=list(names), dtype=object)


def _distinct(values: pd.Series, f: Callable[[str], dict[str, str] | None], names: tuple[str, ...]) -> pd.DataFrame:
    """f once per distinct value; null values and misses give null rows."""
    found = {v: f(v) or {} for v in values.dropna().unique()}
    return pd.DataFrame([[found.get(v, {}).get(n) for n in names] for v in values], columns=list(names), dtype=object)


class Remembered:
    """A function with a memory of bounded size whose answers expire, misses sooner; one for each Python worker."""

    def __init__(self, f: Callable[..., dict[str, str] | None], size: int = 10_000, ttl: float = 300.0, miss_ttl: float = 60.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.f, self.size, self.ttl, self.miss_ttl, self.clock = f, size, ttl, miss_ttl, clock
        self.known: dict[tuple, tuple[float, dict | None]] = {}
        self.name = uuid.uuid4().hex

    def __call__(self, *key: str) -> dict[str, str] | None:
        now = self.clock()
        if (hit := self.known.get(key)) and now < hit[0]:
            return hit[1]
        found = self.f(*key) or None
        if len(self.known) >= self.size:
            self.known.clear()
        self.known[key] = (now + (self.ttl if found else self.miss_ttl), found)
        return found

    def __reduce__(self):
        return Remembered._again, (self.name, self.f, self.size, self.ttl, self.miss_ttl)

    _shared: ClassVar[dict] = {}

    @classmethod
    def _again(cls, name: str, *made) -> Remembered:
        # a worker is sent the function anew with each task: what it knows stays with the worker
        if name not in cls._shared:
            cls._shared[name] = cls(*made)
        return cls._shared[name]


@dataclass(frozen=True)
class Resolver:
    """Name of an address by the system's resolver, given up after a time limit."""

    timeout: float = 2.0

    def __call__(self, address: str) -> dict[str, str] | None:
        import ipaddress
        import socket
        from concurrent.futures import ThreadPoolExecutor

        try:
            ipaddress.ip_address(address)
        except ValueError:
            return None
        pool = ThreadPoolExecutor(1)
        try:
            name = pool.submit(socket.gethostbyaddr, address).result(self.timeout)[0]
        except (OSError, TimeoutError):
            return None
        finally:
            pool.shutdown(wait=False)
        return {"hostname": name.removesuffix(".")} if name else None


def reverse_dns(resolve: Callable[[str], str | None] | None = None, timeout: float = 2.0, ttl: float = 300.0, miss_ttl: float = 60.0, size: int = 10_000) -> Function:
    """hostname of an address; without a resolver of the caller's, the system's, with a time limit and a memory."""
    ask = Remembered(Resolver(timeout), size, ttl, miss_ttl) if resolve is None else lambda v: {"hostname": resolve(v)}
    return Function(lambda x: _distinct(x, ask, ("hostname",)), ("hostname",))


def fetch_url(url: str, timeout: float = 5.0, headers: dict[str, str] | None = None) -> str:
    """Body of a JSON service's answer; anything else is an OSError."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers=headers or {}), timeout=timeout) as answer:
        if answer.status != 200 or "json" not in answer.headers.get("Content-Type", ""):
            raise OSError(f"no JSON from {url}")
        return answer.read().decode("utf-8", "replace")


def picked(body: object, path: str = "") -> dict:
    """What stands in a JSON body at a dotted path ($.a.b[0]): an object, or the first of a list; others give nothing."""
    for name, index in re.findall(r"\.?([A-Za-z_][\w-]*)|\[(\d+|\*)\]", path.removeprefix("$")):
        if name:
            body = body.get(name) if isinstance(body, dict) else None
        else:
            at = 0 if index == "*" else int(index)
            body = body[at] if isinstance(body, list) and at < len(body) else None
    if isinstance(body, list):
        body = body[0] if body else None
    return body if isinstance(body, dict) else {}


def http(
    fetch: Callable[[str], str] | None, template: str, names: tuple[str, ...], paths: tuple[str, ...] = ("",), parameters: tuple[str, ...] | None = None, ttl: float = 300.0, size: int = 10_000
) -> Function:
    """Values of a JSON service: GET of a URL with {parameters} filled in, what stands at each path merged, later ones first.

    Parameters are in the order given, or as they stand in the template. ``fetch`` gives a URL's body; without one ours does.
    """
    fetch = fetch or fetch_url
    parameters = parameters or tuple(dict.fromkeys(f for _, f, _, _ in Formatter().parse(template) if f))

    def ask(*values: str) -> dict | None:
        try:
            body = json.loads(fetch(template.format(**{p: quote(v, safe="") for p, v in zip(parameters, values)})))
        except (OSError, ValueError):
            return None
        found = {k: v for path in paths for k, v in picked(body, path).items()}
        return {n: v if isinstance(v := found.get(n), str) or v is None else json.dumps(v) for n in names}

    known = Remembered(ask, size, ttl)
    return Function(lambda *x: _several(x, known, names), names, len(parameters))


def mmdb(path: str, kind: str = "city") -> Function:
    """An address' place ("city") or network ("asn") from a MaxMind DB file that all workers can read (--files, or a shared folder)."""
    from timberline.sources import mmdb as reader

    names = ("country", "city", "subdivision", "latitude", "longitude", "timezone", "accuracy_radius") if kind == "city" else ("asn", "as_org")
    pick = reader.city if kind == "city" else reader.asn

    def run(x: pd.Series) -> pd.DataFrame:
        database = _open_mmdb(path)
        return _distinct(x, lambda v: pick(found) if isinstance(found := database.find(v), dict) else None, names)

    return Function(run, names)


@lru_cache(maxsize=4)
def _open_mmdb(path: str):
    from pathlib import Path

    from timberline.sources.mmdb import Database

    return Database(Path(path).read_bytes())


def built_in() -> dict[str, Lookup]:
    """The tables that a query has without being given any."""
    return {"rdns": reverse_dns(), "useragent": user_agent()}


_BROWSERS = (("Edge", r"Edg(?:e|A|iOS)?/([\d.]+)"), ("Opera", r"(?:OPR|Opera)/([\d.]+)"), ("Firefox", r"(?:Firefox|FxiOS)/([\d.]+)"), ("Chrome", r"(?:Chrome|CriOS)/([\d.]+)"), ("Safari", r"Version/([\d.]+).*Safari/"), ("curl", r"curl/([\d.]+)"))
_SYSTEMS = (("iOS", r"(?:iPhone|CPU) OS ([\d_]+)"), ("Android", r"Android ([\d.]+)"), ("Windows", r"Windows NT ([\d.]+)"), ("macOS", r"Mac OS X ([\d_.]+)"), ("Linux", r"Linux()"))


def parse_agent(text: str) -> dict[str, str]:
    """Browser, system and device of a user agent, by our own few rules; unknown parts are left out."""
    out: dict[str, str] = {}
    for kind, rules in (("browser", _BROWSERS), ("os", _SYSTEMS)):
        for name, pattern in rules:
            if m := re.search(pattern, text):
                out[kind] = name
                if m[1]:
                    out[f"{kind}_version"] = m[1].replace("_", ".")
                break
    device = re.search(r"\b(iPhone|iPad|Pixel[ \w]*|SM-\w+)\b", text)
    if device:
        out["device"] = device[1].strip()
    if re.search(r"(?i)bot\b|crawl|spider", text):
        out["device_type"] = "bot"
    elif "iPad" in text or "Tablet" in text:
        out["device_type"] = "tablet"
    elif "Mobile" in text or "iPhone" in text:
        out["device_type"] = "mobile"
    elif "os" in out:
        out["device_type"] = "desktop"
    return out


def user_agent() -> Function:
    return Function(lambda x: _distinct(x, parse_agent, AGENT), AGENT)
