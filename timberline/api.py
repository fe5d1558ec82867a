"""The engine's verbs: search, explain, validate, fields, context, histogram, export, follow."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.functions import extract
from timberline.functions.values import render_number
from timberline.lang import ast as A
from timberline.lang import directives
from timberline.lang.errors import QueryError
from timberline.lang.parser import AGGREGATES, SCALARS, parse
from timberline.operators import charts
from timberline.operators.lookup import Lookup
from timberline.operators.timechart import volume
from timberline.operators.transforms import ordered
from timberline.plans import planner
from timberline.plans.frame import INSTANTS, Frame, start
from timberline.plans.predicates import tokens
from timberline.sources.records import STANDARD, Records


@dataclass(frozen=True)
class Result:
    """What a query gives: a lazy frame, with its kind (records or table)."""

    frame: Frame
    query: A.Query
    directives: directives.Directives

    @property
    def kind(self) -> str:
        return self.frame.kind

    def dataframe(self, sort: bool = False) -> DataFrame:
        """Visible columns in their own types; with sort, in the result's order."""
        df = ordered(self.frame) if sort else self.frame.df
        if not self.frame.records:
            return df.select(*[F.col(f"`{c}`").alias(n) for n, c in self.frame.fields.items()])
        standard = [F.col(c) for c in STANDARD if c in df.columns and not (c == "attrs" and self.frame.closed)]
        own = [F.col(f"`{c}`").alias(n) for n, c in self.frame.fields.items() if n not in STANDARD]
        return df.select(*standard, *own)

    def chart(self) -> str:
        """The result's chart type (runs an aggregation over it)."""
        op = next((p for p in self.query.pipes if isinstance(p, A.Chart)), None)
        return charts.chart_type(self.frame, op)

    def render(self) -> DataFrame:
        """Every cell as text, as a terminal shows it; missing cells are empty."""
        df = self.dataframe(sort=True)
        cells = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            if isinstance(f.dataType, T.NumericType):
                c = render_number(c)
            elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
                c = Frame(df, "table", {}).column(f.name).text()
            elif isinstance(f.dataType, T.MapType):
                c = F.to_json(c)
            cells.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
        return df.select(*cells)


def compile_query(text: str, now: datetime | None = None) -> tuple[A.Query, directives.Directives]:
    d, rest = directives.split(text, now)
    return (parse(rest) if rest.strip() else A.Query(None)), d


def search(records: Records, text: str, lookups: dict[str, Lookup] | None = None, now: datetime | None = None, bounds: directives.Directives | None = None) -> Result:
    """Run a query over records; nothing is computed until the result is used."""
    query, d = compile_query(text, now)
    if bounds is not None:
        d = replace(bounds, **{k: v for k, v in vars(d).items() if v not in (None, False) and not (k == "order" and v == "ingest_ts")})
    if any(isinstance(p, A.Export) for p in query.pipes):
        raise QueryError("export is a job: use export()")
    frame = planner.limited(planner.plan(records, query, d, lookups or {}), d.limit)
    return Result(frame, query, d)


def scans(df: DataFrame) -> list[dict[str, object]]:
    """Of each file scan of a plan: files read and files there are, its filters, the columns it reads."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.initialPlan()
    out, leaves = [], plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "FileSourceScanExec":
            continue
        facts = leaf.metadata()
        given = lambda name, facts=facts: facts.get(name).get() if facts.contains(name) else ""
        every = leaf.relation().location().inputFiles()
        chosen = leaf.selectedPartitions()
        out.append({"files": chosen.totalNumberOfFiles(), "of": len(every), "bytes": chosen.totalFileSize(), "partition_filters": given("PartitionFilters"), "pushed_filters": given("PushedFilters"), "columns": given("ReadSchema")})
    return out


def explain(records: Records, text: str, lookups: dict[str, Lookup] | None = None) -> str:
    """Our logical plan, what each scan prunes and pushes down, then Spark's plan."""
    query, d = compile_query(text)
    frame = planner.plan(records, query, d, lookups or {})
    lines = [f"read {x['files']} of {x['of']} files, {x['bytes']} bytes; partitions {x['partition_filters'] or '[]'}; pushed {x['pushed_filters'] or '[]'}; columns {x['columns']}" for x in scans(frame.df)]
    physical = frame.df._sc._jvm.PythonSQLUtils.explainString(frame.df._jdf.queryExecution(), "formatted")
    return "\n".join([planner.describe(query, d), *lines]) + "\n\n" + physical


def analyze(records: Records) -> DataFrame:
    """Per vault, chunk and kind of field (token, attr, kv, json): what an index of it would cover.

    records, bytes (of raw), covered (records with any), percent, keys and pairs (distinct), entries. The engine itself relies on the
    statistics in Parquet files; this says which fields are worth promoting to columns.
    """
    frame = start(records)
    df, none = frame.df, F.array().cast("array<struct<k:string,v:string>>")
    pair = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    own = [pair(F.lit(n), frame.column(c).text()) for n, c in frame.fields.items()]
    attrs = F.filter(F.array(*own), lambda p: p["v"].isNotNull()) if own else none
    if frame.has("attrs"):
        attrs = F.concat(attrs, F.transform(F.map_entries(F.coalesce("attrs", F.create_map().cast("map<string,string>"))), lambda e: pair(e["key"], e["value"])))
    kinds = {"attr": attrs}
    if frame.has("raw"):
        kinds["token"] = F.transform(tokens(F.coalesce("raw", F.lit(""))), lambda t: pair(t, F.lit(None).cast("string")))
    if frame.has("pairs"):
        for name, s in (("kv", extract.KV), ("json", extract.JSON)):
            kinds[name] = F.transform(F.filter("pairs", lambda p, s=s: p["s"] == s), lambda p: pair(p["k"], p["v"]))
    where = [(F.col(c) if frame.has(c) else F.lit(None).cast("string")).alias(c) for c in ("vault_id", "chunk_id")]
    size = F.octet_length("raw").cast("bigint") if frame.has("raw") else F.lit(0).cast("bigint")
    each = df.select(*where, size.alias("size"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("found")) for k, c in kinds.items()])).alias("x"))
    at = ["vault_id", "chunk_id", "kind"]
    each = each.select("vault_id", "chunk_id", "size", "x.kind", "x.found")
    totals = each.groupBy(*at).agg(
        F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(F.size("found") > 0).alias("covered"), F.sum(F.size("found")).cast("bigint").alias("entries")
    )
    # distinct pairs first, then keys: two aggregations with partial sums, no sets in memory
    pairs = each.select(*at, F.explode("found").alias("p")).select(*at, "p.k", "p.v").distinct()
    keys = pairs.groupBy(*at, "k").agg(F.count(F.lit(1)).alias("n")).groupBy(*at).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("pairs"))
    same = F.lit(True)
    for c in at:
        same = same & F.col(f"t.{c}").eqNullSafe(F.col(f"k.{c}"))
    joined = totals.alias("t").join(keys.alias("k"), same, "left")
    return joined.select(*[F.col(f"t.{c}") for c in (*at, "records", "bytes", "covered", "entries")], (100.0 * F.col("covered") / F.col("records")).alias("percent"), *[F.coalesce(F.col(f"k.{c}"), F.lit(0)).alias(c) for c in ("keys", "pairs")])


def validate(text: str) -> tuple[bool, str, int]:
    """(valid, message, offset)."""
    try:
        compile_query(text)
    except QueryError as e:
        return False, e.message, e.position
    return True, "", 0


def syntax() -> dict[str, list[str]]:
    """Names that completion and highlighting need, from the same tables the parser uses."""
    pipes = ["where", "eval", "sort", "head", "tail", "slice", "rename", "fields", "timechart", "dedup", "lookup", "raw", "stats", "linechart", "barchart", "donut", "heatmap", "scatter", "map", "export"]
    return {"directives": list(directives.NAMES), "pipes": pipes, "functions": sorted(SCALARS), "aggregates": list(AGGREGATES)}


def pipeline_fields(text: str, base: list[str]) -> list[str]:
    return planner.field_names(compile_query(text)[0], base)


def histogram(records: Records, text: str, buckets: int = 50) -> DataFrame:
    """The volume histogram of a search: bucket, level, count."""
    query, d = compile_query(text)
    frame = planner.filtered(planner.bounded(start(records, True, d.order), d), query.filter)
    return Result(volume(frame, d.start, d.end, buckets), query, d).dataframe()


def fields(records: Records, text: str, sample: int = 500, top: int = 10) -> DataFrame:
    """Field discovery over a bounded sample of matches: kind (attr or kv), key, key_count, value, value_count."""
    query, d = compile_query(text)
    frame = planner.filtered(planner.bounded(start(records, True, d.order, d.reverse), d), query.filter)
    rows = frame.with_df(ordered(frame).limit(min(sample, 2000)))
    attrs = [F.struct(F.lit(n).alias("k"), rows.column(c).text().alias("v")) for n, c in rows.fields.items()]
    own = F.filter(F.array(*attrs), lambda p: p["v"].isNotNull()) if attrs else F.array().cast("array<struct<k:string,v:string>>")
    if rows.has("attrs"):
        own = F.concat(own, F.transform(F.map_entries("attrs"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    pairs = F.filter("pairs", lambda p: (p["s"] < 2) & (p["k"] != "level")) if rows.has("pairs") else F.array().cast("array<struct<k:string,v:string>>")
    kv = F.transform(pairs, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")))
    both = rows.df.select(own.alias("attr"), kv.alias("kv"))
    flat = both.select(F.lit("attr").alias("kind"), F.explode("attr").alias("p")).unionByName(both.select(F.lit("kv").alias("kind"), F.explode("kv").alias("p")))
    counted = flat.groupBy("kind", F.col("p.k").alias("key"), F.col("p.v").alias("value")).agg(F.count(F.lit(1)).alias("value_count"))
    key = Window.partitionBy("kind", "key")
    rank = F.row_number().over(key.orderBy(F.desc("value_count"), "value"))
    return counted.withColumn("key_count", F.sum("value_count").over(key)).withColumn("rank", rank).where(F.col("rank") <= top).drop("rank")


# --- pagination, context ---------------------------------------------------------------


def _token(row: T.Row, columns: list[str]) -> str:
    return json.dumps([v.isoformat() if isinstance(v := row[c], datetime) else v for c in columns])


def _paged(records: Records, text: str, token: str | None, now: datetime | None) -> Frame:
    """The frame of a search, behind a token if there is one."""
    frame = search(records, text, now=now).frame
    if not frame.records or frame.sorted:
        raise QueryError("only unsorted record searches have pages")
    if token is None:
        return frame
    after, equal = F.lit(False), F.lit(True)
    for o, v in zip(frame.order, json.loads(token)):
        c = F.col(o.column)
        kind = frame.df.schema[o.column].dataType
        at = F.lit(v).cast(kind)
        beyond = c < at if o.descending else c > at
        if v is None:
            beyond = F.lit(False) if o.descending else c.isNotNull()
        elif o.descending:
            beyond = beyond | c.isNull()
        after = after | (equal & F.coalesce(beyond, F.lit(False)))
        equal = equal & c.eqNullSafe(at)
    return frame.with_df(frame.df.where(after))


def page(records: Records, text: str, size: int, token: str | None = None, now: datetime | None = None) -> tuple[list, str | None]:
    """(rows, token for the next page or null). Keyset pagination: a token is the last row's order key."""
    frame = _paged(records, text, token, now)
    found = ordered(frame).limit(size + 1).collect()
    return found[:size], (_token(found[size - 1], [o.column for o in frame.order]) if len(found) > size else None)


def pages(records: Records, text: str, size: int, token: str | None = None, now: datetime | None = None) -> DataFrame:
    """All pages (behind a token) at once: page_no and row_no, from 0, and the record.

    A page by itself reads all its search again, so that a walk over many reads the table as often; here rows are numbered by
    time slices, in four passes however many pages there are, and none comes to the driver.
    """
    frame = _paged(records, text, token, now)
    numbered = Slices.of(frame, column=frame.order[0].column).numbered(frame)
    row = F.col("__n") - 1
    visible = [F.col(f"`{c}`").alias(n) for n, c in frame.fields.items()]
    return numbered.select(F.floor(row / size).alias("page_no"), row.alias("row_no"), *[c for c in STANDARD if c in numbered.columns], *visible)


def search_then_follow(records: Records, text: str) -> DataFrame:
    """The first match, and everything after it in order, filtered or not.

    The first match's key (one row) is fetched, so that the rest is a comparison with literals: its time bound reaches the scan.
    """
    query, d = compile_query(text)
    frame = planner.bounded(start(records, True, d.order), d)
    columns = [o.column for o in frame.order]
    key = F.struct(*[F.col(c) for c in columns])
    first = planner.filtered(frame, query.filter).df.agg(F.min(key).alias("__first")).first()["__first"]
    if first is None:
        return Result(frame.with_df(frame.df.limit(0)), query, d).dataframe()
    at = [F.lit(first[c]).cast(frame.df.schema[c].dataType) for c in columns]
    rest = frame.df if first[columns[0]] is None else frame.df.where(F.col(columns[0]) >= at[0])
    return Result(frame.with_df(rest.where(key >= F.struct(*[x.alias(c) for x, c in zip(at, columns)]))), query, d).dataframe()


def with_context(records: Records, text: str, before: int = 5, after: int = 5) -> DataFrame:
    """Each match with its neighbours in append order: match_no, offset, and the record; repeats are kept.

    Rows are numbered by time slices (see Slices). Only slices that hold a match or a neighbour of one
    are sorted; the others are left out by literal time bounds.
    """
    query, d = compile_query(text)
    frame = planner.bounded(start(records, True, "ingest_ts"), d)
    slices = Slices.of(frame)
    held = planner.filtered(frame, query.filter).df.select(slices.number().alias("s")).distinct().collect()  # a number a slice
    wanted = slices.around({r["s"] for r in held}, before, after)
    numbered = slices.numbered(frame, wanted)
    hits = planner.filtered(frame.with_df(numbered), query.filter).df
    if wanted is not None:
        hits = hits.where(slices.number().isin(sorted(r["s"] for r in held)))
    hits = hits.select(F.col("__n").alias("match_no"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset"))
    near = hits.withColumn("__at", F.col("match_no") + F.col("offset"))
    visible = [F.col(f"`{c}`").alias(n) for n, c in frame.fields.items()]
    rows = numbered.select(F.col("__n").alias("__row"), *[c for c in STANDARD if c in numbered.columns], *visible)
    return near.join(rows, near["__at"] == rows["__row"]).drop("__at", "__row")


SLICE_ROWS = 500_000
MOST_SLICES = 4_096


@dataclass(frozen=True)
class Slices:
    """Time slices of a frame, and how many rows lie before each.

    A row's slice hangs on its time and on bounds fetched once, not on how Spark happens to partition it, so
    counts and ranks agree however often the rows are read. Rows with one time share a slice.
    """

    bounds: tuple[int, ...]
    sizes: dict[int, int]
    column: str = "ingest_ts"

    @classmethod
    def of(cls, frame: Frame, rows: int = SLICE_ROWS, most: int = MOST_SLICES, *, column: str = "ingest_ts") -> Slices:
        us = F.unix_micros(F.col(column).cast("timestamp"))
        total = frame.df.count()
        parts = max(1, min(most, total // rows))
        shares = [i / parts for i in range(1, parts)]
        cuts = frame.df.agg(F.percentile_approx(us, shares, 20 * parts).alias("q")).first()["q"] if shares else None
        found = cls(tuple(sorted(set(cuts or ()))), {}, column)
        counted = frame.df.groupBy(found.number().alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a slice
        return replace(found, sizes={r["s"]: r["n"] for r in counted})

    def number(self) -> Column:
        """How many bounds are at most the row's time, by a search in two levels; rows without a time come first."""
        if not self.bounds:
            return F.lit(0)
        us = F.unix_micros(F.col(self.column).cast("timestamp"))
        step = max(1, int(len(self.bounds) ** 0.5))
        parts = [self.bounds[i : i + step] for i in range(0, len(self.bounds), step)]
        heads = F.array(*[F.lit(p[0]) for p in parts])
        inner = F.array(*[F.array(*map(F.lit, p)) for p in parts])
        at = F.size(F.filter(heads, lambda h: h <= us))
        within = F.size(F.filter(F.element_at(inner, F.greatest(at, F.lit(1))), lambda x: x <= us))
        return F.when(us.isNull() | (at == 0), F.lit(0)).otherwise((at - 1) * step + within)

    def around(self, held: set[int], before: int, after: int) -> list[int]:
        """The slices that neighbours of rows in ``held`` can be in."""
        present = sorted(self.sizes)
        place = {s: i for i, s in enumerate(present)}
        wanted = set(held)
        for s in held:
            for step, reach in ((-1, before), (1, after)):
                i = place[s] + step
                while reach > 0 and 0 <= i < len(present):
                    wanted.add(present[i])
                    reach -= self.sizes[present[i]]
                    i += step
        return sorted(wanted)

    def numbered(self, frame: Frame, wanted: list[int] | None = None) -> DataFrame:
        """The rows (of the wanted slices) with ``__n``, their place in the frame's order, from 1."""
        df = frame.df
        if wanted is not None:
            df = df.where(self._within(df, wanted)).where(self.number().isin(wanted))
        ahead, total = [0] * (len(self.bounds) + 1), 0
        for s in range(len(ahead))[:: -1 if frame.order[0].descending else 1]:
            ahead[s] = total
            total += self.sizes.get(s, 0)
        place = F.row_number().over(Window.partitionBy("__s").orderBy(*[o.key() for o in frame.order]))
        df = df.withColumn("__s", self.number())
        return df.withColumn("__n", place + F.element_at(F.array(*map(F.lit, ahead)), F.col("__s") + 1).cast("bigint")).drop("__s")

    def _within(self, df: DataFrame, wanted: list[int]) -> Column:
        """One bound above and one below all wanted slices, for the scan."""
        if not wanted:
            return F.lit(False)
        out, kind = F.lit(True), df.schema[self.column].dataType
        # times without a zone may be read an hour off near a change of clocks
        slack = 2 * 3_600_000_000 if isinstance(kind, T.TimestampNTZType) else 0
        time = lambda us: F.timestamp_micros(F.lit(us)).cast(kind)
        if wanted[0] > 0:
            out = out & (F.col(self.column) >= time(self.bounds[wanted[0] - 1] - slack))
        if wanted[-1] < len(self.bounds):
            late = F.col(self.column) < time(self.bounds[wanted[-1]] + slack)
            out = out & (late | F.col(self.column).isNull() if wanted[0] == 0 else late)
        return out


def number_rows(frame: Frame) -> DataFrame:
    """df with ``__n``, the row's place in the frame's order, from 1."""
    return Slices.of(frame).numbered(frame)


def context(records: Records, anchor: dict, before: int = 5, after: int = 5) -> DataFrame:
    """Records around one (a dict of identity and ingest_ts): strictly earlier ones, and those not earlier but itself."""
    before, after = min(before, 50), min(after, 50)
    frame = start(records, False)
    at = F.lit(anchor["ingest_ts"]).cast("timestamp")
    same = F.lit(True)
    for k, v in anchor.items():
        same = same & F.col(k).eqNullSafe(F.lit(v).cast(frame.df.schema[k].dataType))
    ts = F.col("ingest_ts").cast("timestamp")
    low, high = frame.with_df(frame.df.where(ts < at)), frame.with_df(frame.df.where((ts >= at) & ~same))
    return Result(frame, A.Query(None), directives.Directives()).dataframe().limit(0).unionByName(
        Result(low.with_df(ordered(low, flip=True).limit(before)), A.Query(None), directives.Directives()).dataframe()
    ).unionByName(Result(high.with_df(ordered(high).limit(after)), A.Query(None), directives.Directives()).dataframe())


# --- export ------------------------------------------------------------------------------


def export(records: Records, text: str, path: str, lookups: dict[str, Lookup] | None = None) -> int:
    """Append a query's records to a vault under path (Parquet, partitioned by vault_id); returns their number.

    The target vault is never a source; naming it as one is an error.
    """
    query, d = compile_query(text)
    if not query.pipes or not isinstance(query.pipes[-1], A.Export):
        raise QueryError("the query does not end in export")
    vault = query.pipes[-1].vault
    if any(isinstance(f, A.Compare) and f.key == "vault_id" and f.value == vault for f in _terms(query.filter)):
        raise QueryError(f"vault {vault} can't be exported to itself")
    frame = planner.plan(replace(records, df=records.df.where(F.col("vault_id") != vault)) if records.has("vault_id") else records, query, d, lookups or {})
    return write_records(frame, vault, path)


def _terms(f: object) -> list:
    match f:
        case A.And(ts) | A.Or(ts):
            return [x for t in ts for x in _terms(t)]
    return [f]


def write_records(frame: Frame, vault: str, path: str) -> int:
    """Writes the records; returns how many, as counted while they are written."""
    df = frame.df
    own = [F.struct(F.lit(n).alias("key"), frame.column(c).text().alias("value")) for n, c in frame.fields.items()]
    attrs = F.map_from_entries(F.filter(F.array(*own), lambda e: e["value"].isNotNull())) if own else F.create_map().cast("map<string,string>")
    if "attrs" in df.columns and not frame.closed:
        attrs = F.map_concat(F.map_filter("attrs", lambda k, _: ~k.isin(list(frame.fields) or [""])), attrs)
    columns = [c for c in (*INSTANTS, "ingester_id", "node_id", "ingest_seq", "raw") if c in df.columns]
    out = df.select(F.lit(vault).alias("vault_id"), attrs.alias("attrs"), *columns)
    written = Observation()
    out.observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("vault_id").parquet(path)
    return written.get["n"]
