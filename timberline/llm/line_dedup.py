"""Line dedup by site-relative frequency.

A line's frequency is the share of its host's pages that contain it. Lines on at
least ``least_pages`` pages and above ``ratio`` of the host's pages are dropped
from every page of the host; the other lines keep their order. All of it is DataFrame
functions: texts are never shuffled for counting, only 128-bit line digests, and these are
counted per task first, so a host with a third of all pages isn't a hot key. A page's lines are made distinct and
held against its host's list by hashing, so that time is linear in the lines of a page and of the list; only what a page
itself drops is searched for each of its lines.

A host has at most (mean lines a page) / ratio such lines, hence the table
of dropped lines has a few rows a host; it goes to all executors only if its counted size
is below ``broadcast_rows``, else it is joined by host with pages salted.

Null texts stay null with 0 lines; a null host is a host of its own; lines are compared whole
after trimming ASCII white space; lines without a word are never dropped. Repeated rows count as pages each.
Columns other than text pass through, in a struct of their own, so that they may have any names but that of
the column that is added. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import documents, materialize

RATIO = 0.05
LEAST_PAGES = 3
BROADCAST_ROWS = 200_000
SALTS = 32
#: white space within a line that isn't a space
SPACES = "\t\x0b\x0c\r"


def _trimmed(line: Column) -> Column:
    """The line with ASCII white space as spaces, trimmed; translate makes an object of each character, so it only gets lines that it changes."""
    changes = reduce(or_, [F.contains(line, F.lit(c)) for c in SPACES])
    return F.trim(F.when(changes, F.translate(line, SPACES, " " * len(SPACES))).otherwise(line))


def _digest(line: Column) -> Column:
    """128 bits of the trimmed line, as text: arrays of texts are compared by hashing, those of structs aren't."""
    return F.md5(_trimmed(line).cast("binary"))


def page_lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(pages: DataFrame, text: str, host: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, pages, lines array<string>: the digests to drop, for hosts that have any."""
    totals = pages.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    distinct = F.array_distinct(F.transform(page_lines(F.col(text)), _trimmed))
    lines = pages.select(F.col(host).alias("host"), F.explode(distinct).alias("line")).where("line <> ''")
    lines = lines.select("host", F.unhex(F.md5(F.col("line").cast("binary"))).alias("line"))
    counted = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    # the totals: one row a host, on the smaller side of this join
    share = counted.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    kept = share.where(F.col("n") > ratio * F.col("pages")).select("c.host", "pages", F.lower(F.hex("line")).alias("line"))
    return kept.groupBy("host", "pages").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def drop_boilerplate(
    pages: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """pages with text less its boilerplate lines, plus ``__line_dedup`` struct<n_lines, n_dropped> (instead of a column of that name)."""
    table = materialize(boilerplate(pages, text, host, ratio, least_pages), "boilerplate")
    size = table.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)) + F.count(F.lit(1))).first()[0]
    small = table.select(F.col("host").alias("h"), F.col("lines").alias("drop"))
    mine = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("t"))
    same = F.col("host").eqNullSafe(F.col("h"))
    if size <= broadcast_rows:
        joined = mine.join(F.broadcast(small), same, "left")
    else:
        salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = mine.withColumn("own", F.pmod(F.xxhash64("t"), F.lit(SALTS))).join(salted, same & (F.col("own") == F.col("salt")), "left")
    every = F.transform(page_lines(F.col("t")), lambda x: F.struct(x.alias("line"), _digest(x).alias("d")))
    found = joined.select("row", "t", "drop", F.when(F.col("drop").isNotNull(), every).alias("every"))
    found = found.withColumn("hits", F.array_intersect(F.col("every.d"), F.col("drop")))
    # the digest of an empty line is on no list
    stay = F.transform(F.filter("every", lambda x: ~F.array_contains(F.col("hits"), x["d"])), lambda x: x["line"])
    found = found.withColumn("stay", F.when(F.size("hits") > 0, stay))
    lines = F.coalesce(F.size(page_lines(F.col("t"))), F.lit(0))
    lines = F.when(F.col("t").isNull(), F.lit(0)).otherwise(lines)
    gone = F.when(F.col("stay").isNotNull(), lines - F.size("stay")).otherwise(F.lit(0))
    kept = F.when(F.col("stay").isNotNull(), F.array_join("stay", "\n")).otherwise(F.col("t"))
    rest = [kept.alias(c) if c == text else F.col(f"row.`{c}`") for c in pages.columns if c != "__line_dedup"]
    return found.select(*rest, F.struct(lines.alias("n_lines"), gone.alias("n_dropped")).alias("__line_dedup"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(documents(spark, sf_dir))
    return out.select(
        "doc_id",
        "source",
        F.col("__line_dedup.n_lines").cast("long").alias("n_lines"),
        F.col("__line_dedup.n_dropped").cast("long").alias("n_dropped"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


OP10_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, i, line, trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    ')) AS key
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
boiler AS (
  SELECT l.source, l.key FROM (SELECT source, key, count(DISTINCT doc_id) AS n FROM lines WHERE key <> '' GROUP BY source, key) l
  JOIN totals t ON l.source IS NOT DISTINCT FROM t.source WHERE n >= {LEAST_PAGES} AND n > {RATIO} * pages
), judged AS (
  SELECT l.*, b.key IS NOT NULL AS gone FROM lines l LEFT JOIN boiler b ON l.source IS NOT DISTINCT FROM b.source AND l.key = b.key
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS t FROM judged GROUP BY doc_id
)
SELECT d.doc_id, d.source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(t) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
