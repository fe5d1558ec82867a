"""Sinks: vaults as partitioned Parquet, JSON lines, text and CSV; and where records are routed to."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from timberline.lang import ast as A
from timberline.lang.errors import QueryError
from timberline.lang.parser import parse_filter
from timberline.plans.frame import Frame
from timberline.plans.predicates import compile_filter


def vault(df: DataFrame, path: str, records_per_file: int = 0) -> None:
    """Append records to a folder with a partition a vault."""
    df.write.mode("append").option("maxRecordsPerFile", records_per_file).partitionBy("vault_id").parquet(path)


def imported(df: DataFrame, vault_id: str, now: datetime) -> DataFrame:
    """Records of elsewhere for a vault: identities and other times stay, the write time is the import's."""
    return df.withColumn("vault_id", F.lit(vault_id)).withColumn("write_ts", F.lit(now).cast("timestamp"))


def vault_batch(batch: DataFrame, routes: list[Route], path: str, name: str) -> dict[str, int]:
    """Route one micro-batch into vaults so that a repeated run of it adds nothing.

    Files are written beside the vaults first, under the batch's name, then moved; files that an earlier
    run of the batch moved are deleted before. Returns how many records came, and how many went nowhere.
    """
    spark = batch.sparkSession
    seen, staging = Observation(), f"{path}/_staging/{name}"
    marked = batch.observe(seen, F.count(F.lit(1)).alias("records"))
    routed = route(marked, routes, keep_unrouted=True)
    gone = Observation()
    routed = routed.observe(gone, F.count_if(F.col("vault_id").isNull()).alias("unrouted")).where("vault_id is not null")
    routed.write.mode("overwrite").partitionBy("vault_id").parquet(staging)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in files.globStatus(hadoop(f"{path}/vault_id=*/{name}-part-*")) or []:
        files.delete(old.getPath(), False)
    for new in files.globStatus(hadoop(f"{staging}/vault_id=*/part-*")) or []:
        at = new.getPath()
        home = hadoop(f"{path}/{at.getParent().getName()}")
        files.mkdirs(home)
        if not files.rename(at, hadoop(home, f"{name}-{at.getName()}")):
            raise OSError(f"can't move {at} to {home}")
    files.delete(hadoop(staging), True)
    return {"records": seen.get["records"], "unrouted": gone.get["unrouted"]}


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object a record: times, attributes, raw (base64 if it isn't UTF-8)."""
    raw = F.col("raw")
    if dict(df.dtypes)["raw"] == "binary":
        raw = F.when(F.is_valid_utf8(F.col("raw").cast("string")), F.col("raw").cast("string")).otherwise(F.base64("raw"))
    return df.select(*[c for c in ("source_ts", "ingest_ts", "write_ts", "attrs") if c in df.columns], raw.alias("raw"))


def json_lines(df: DataFrame, path: str) -> None:
    json_rows(df).write.mode("append").json(path)


def lines(df: DataFrame, form: str, columns: list[str] | None = None) -> DataFrame:
    """One text line a row: form is text (raw), json, csv or raw."""
    df = df.select(*columns) if columns else df
    if form in ("text", "raw"):
        return df.select(F.col("raw").cast("string").alias("line")) if "raw" in df.columns else df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in df.columns]).alias("line"))
    if form == "json":
        return df.select(F.to_json(F.struct(*df.columns)).alias("line"))
    if form == "csv":
        return df.select(F.to_csv(F.struct(*df.columns)).alias("line"))
    raise ValueError(f"unknown form {form}")


# --- routing -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Route:
    """vault gets records that match: "" nothing, "*" all, "+" what no expression route matched, else a filter of attributes.

    With further vaults in ``others`` the mode says who gets a record: "fanout" all of them, "round-robin" one in
    turn (by the record's sequence number), "failover" the first that isn't in ``down``.
    """

    vault: str
    match: str = ""
    others: tuple[str, ...] = ()
    mode: str = "fanout"
    down: frozenset[str] = frozenset()

    def targets(self, hit: Column, turn: Column) -> list[Column]:
        """Per record: the vaults it goes to, null where it doesn't match."""
        vaults = (self.vault, *self.others)
        if self.mode == "fanout" or len(vaults) == 1:
            return [F.when(hit, v) for v in vaults]
        if self.mode == "round-robin":
            return [F.when(hit, F.element_at(F.array(*map(F.lit, vaults)), (F.pmod(turn, F.lit(len(vaults))) + 1).cast("int")))]
        if self.mode == "failover":
            alive = [v for v in vaults if v not in self.down]
            return [F.when(hit, alive[0])] if alive else []
        raise QueryError(f"unknown distribution {self.mode!r}")


def attributes_only(f: object) -> object:
    """The filter, if it reads attributes and nothing else."""
    match f:
        case A.Token() | A.Regex() | A.BareGlob() | A.ExprCompare():
            raise QueryError("routes compare attributes only")
        case A.Not(t):
            attributes_only(t)
        case A.And(ts) | A.Or(ts):
            for t in ts:
                attributes_only(t)
    return f


def route(df: DataFrame, routes: list[Route], promoted: dict[str, str] | None = None, keep_unrouted: bool = False) -> DataFrame:
    """Each record once per vault it goes to (column vault_id); records without one are dropped, or have a null."""
    own = df.drop("vault_id", "pairs")
    frame = Frame(own.drop("raw"), "records", promoted or {})
    turn = F.coalesce("ingest_seq", F.lit(0)) if "ingest_seq" in own.columns else F.monotonically_increasing_id()
    named: list[Column] = []
    any_match = F.lit(False)
    for r in routes:
        if r.match not in ("", "*", "+"):
            hit = F.coalesce(compile_filter(attributes_only(parse_filter(r.match)), frame), F.lit(False))
            named += r.targets(hit, turn)
            any_match = any_match | hit
    for r in routes:
        if r.match in ("*", "+"):
            named += r.targets(F.lit(True) if r.match == "*" else ~any_match, turn)
    if not named:
        named = [F.lit(None).cast("string")]
    vaults = F.array_distinct(F.array_compact(F.array(*named)))
    return own.withColumn("vault_id", F.explode_outer(vaults) if keep_unrouted else F.explode(vaults))
