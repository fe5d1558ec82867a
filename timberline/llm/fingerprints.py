"""Document fingerprints as invertible Bloom lookup tables.

A text's paragraphs are cut into cells where their content says so: behind a word that ends in one of some letters or signs,
at lengths between a least and a most (shorter in the first 256 characters, and pairs in the first 16, so that short texts
resolve too). Text put in or taken out moves the cuts near it only; cells further on are found again. Each cell's digest carries
its length in the low byte. The set of digests
fills a table of cells (count, xor of digests, xor of their hashes): every digest is in one cell of
each of three blocks of four. Tables of two versions subtract cell by cell, what they share cancels,
and peeling (a cell with count +1 or -1 whose hash fits names a digest, which leaves its other
cells) recovers the digests that differ. The first try uses the fingerprint's 12 cells; on failure
eight tables by three more digest bits (the small one is their sum); of these and of each later size, those that can't be peeled are
split into eight larger ones in their place, down to ``RUNGS`` sizes (4,096 tables of each eighth, 393,216 cells in all). Likeness is the
share of both versions' characters in digests that they share.

Everything is DataFrame functions. Documents are bucketed by quantiles of doc_id; the first
document of a bucket is copied into the bucket before, so that one shuffle of the texts gives every
document its successor, and no window spans more than a bucket.

Null texts are empty; two empty texts are alike (1.0). Null doc_ids sort first. Repeated
doc_ids follow each other by text. With one document, it is its own successor. Repeated cells count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.llm.common import documents, text_or_empty

SUBTABLES = 8
CELLS = 12
#: as many rounds as there are cells: each recovers one digest at least, or none is left to recover
ROUNDS = CELLS
#: sizes of tables after the 12 cells and the eight tables
RUNGS = 4
CUT = "[a-hA-H0-4.,;:!?][ \\t\\r\\n]+"
#: where a zone starts, its length if it ends, pattern of its cells; any character is (?s). as Java takes ten times as long for [\s\S]
ZONES = (
    (1, 16, r"(?s).{1,2}"),
    (17, 240, rf"(?s).{{4,40}}?{CUT}|.{{1,40}}"),
    (257, None, rf"(?s).{{48,180}}?{CUT}|.{{1,180}}"),
)
NULL_KEY = -(2**63)
CELL = "struct<n:int,k:bigint,c:bigint>"


def digests(text: str) -> Column:
    """The set of cell digests of a text column, each with its cell's length in the low byte."""
    parts = [F.regexp_extract_all(F.substr(F.col(text), F.lit(at), F.lit(size or 2**31 - 1)), F.lit(pattern), F.lit(0)) for at, size, pattern in ZONES]
    pieces = F.transform(F.concat(*parts), lambda p: F.substr(p, F.lit(1), F.lit(255)))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p).bitwiseAND(F.lit(-256)).bitwiseOR(F.length(p))))


def _let(name: str, value: str, body: str, kind: str = "CAST(NULL AS BIGINT)") -> str:
    """body (of kind's type) with name for value. transform(array(value), name -> body)[0] would ask all of body for its type, each time."""
    return f"aggregate(array({value}), {kind}, (unused, {name}) -> {body})"


def weight(ds: str) -> str:
    return f"aggregate({ds}, 0L, (a, d) -> a + (d & 255L))"


#: the cells as constants: which bits of a digest to look at, and what they are
_CELL = [f"named_struct('m', {3 << 8 + 2 * (i // 4)}L, 'v', {i % 4 << 8 + 2 * (i // 4)}L)" for i in range(CELLS)]
_EACH = f"array({', '.join(_CELL)})"
_IN = "d -> (d & i.m) = i.v"


def _cells(ds: str) -> str:
    """The 12 cells of the digests in an array."""
    empty = "named_struct('n', 0, 'k', 0L, 'c', 0L)"
    add = "(a, d) -> named_struct('n', a.n + 1, 'k', a.k ^ d, 'c', a.c ^ xxhash64(d))"
    return f"transform({_EACH}, i -> aggregate(filter({ds}, {_IN}), {empty}, {add}))"


def _parts(rung: int) -> str:
    """The eight sub-tables of a rung, as their digests' bits."""
    return "array(" + ", ".join(f"{s << 40 + 3 * rung}L" for s in range(SUBTABLES)) + ")"


def _part(ds: str, rung: int, s: str = "s") -> str:
    """Of the digests of one table, those of its sub-table s (of _parts) at a rung."""
    return f"filter({ds}, d -> (d & {7 << 40 + 3 * rung}L) = {s})"


def subtables(ds: str) -> Column:
    """The eight tables of a digest array column: array<array<cell>>."""
    return F.expr(f"transform(transform({_parts(0)}, s -> {_part(ds, 0)}), mine -> {_cells('mine')})")


def folded(tables: str) -> Column:
    """The sum of the eight tables: the 12-cell table of all digests."""
    add = "(a, t) -> zip_with(a, t, (x, y) -> named_struct('n', x.n + y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"
    return F.expr(f"aggregate(slice({tables}, 2, {SUBTABLES - 1}), {tables}[0], {add})")


def fingerprint(table: str) -> Column:
    return F.expr(f"translate(array_join(transform({table}, x -> concat(lpad(hex(x.n), 8, '0'), lpad(hex(x.k), 16, '0'), lpad(hex(x.c), 16, '0'))), ''), 'ABCDEF', 'abcdef')")


def difference(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"


def peeled(cells: str) -> str:
    """Summed weight of the digests peeled from a difference table; null if peeling fails.

    A table that is done or stuck leaves its cells behind, as each further round copies what is left of it.
    """
    pure = "array_distinct(transform(filter(st.cells, x -> abs(x.n) = 1 AND xxhash64(x.k) = x.c), x -> named_struct('k', x.k, 'n', x.n)))"
    less = "(a, p) -> named_struct('n', a.n - p.n, 'k', a.k ^ p.k, 'c', a.c ^ xxhash64(p.k))"
    rest = f"zip_with(st.cells, {_EACH}, (c, i) -> aggregate(filter(pure, p -> (p.k & i.m) = i.v), c, {less}))"
    left = "exists(st.cells, x -> x.n <> 0 OR x.k <> 0L OR x.c <> 0L)"
    ended = f"named_struct('cells', slice(st.cells, 1, 0), 'w', if({left}, -1L, st.w), 'go', false)"
    moved = f"named_struct('cells', {rest}, 'w', st.w + aggregate(pure, 0L, (a, p) -> a + (p.k & 255L)), 'go', true)"
    step = f"if(st.go, {_let('pure', pure, f'if(size(pure) = 0, {ended}, {moved})', 'st')}, st)"
    end = f"if(st.w < 0 OR {left}, NULL, st.w)"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'w', 0L, 'go', true), (st, r) -> {step}, st -> {end})"


def named(block: str) -> str:
    """Summed weight of the digests in a block of four difference cells; null unless each cell is empty or names one digest.

    Every digest is in one cell of the block, so such a block says all without any peeling.
    """
    clear = "x.k = 0L AND x.c = 0L OR xxhash64(x.k) = x.c"
    return _let("four", block, f"if(forall(four, x -> {clear}), aggregate(four, 0L, (w, x) -> w + (x.k & 255L)), NULL)")


def decided(cells: str) -> str:
    """As peeled, but blocks that name all digests come first, and no round is begun where no cell names one."""
    blocks = ", ".join(named(f"slice(whole, {at + 1}, 4)") for at in range(0, CELLS, 4))
    some = "exists(whole, x -> abs(x.n) = 1 AND xxhash64(x.k) = x.c)"
    return _let("whole", cells, f"coalesce({blocks}, if({some}, {peeled('whole')}, NULL))")


def _both(a: str, b: str) -> str:
    """The difference table of two digest arrays, made at once."""
    empty = "named_struct('n', 0, 'k', 0L, 'c', 0L)"
    add = "(t, d) -> named_struct('n', t.n + 1, 'k', t.k ^ d, 'c', t.c ^ xxhash64(d))"
    less = "(t, d) -> named_struct('n', t.n - 1, 'k', t.k ^ d, 'c', t.c ^ xxhash64(d))"
    return f"transform({_EACH}, i -> aggregate(filter({b}, {_IN}), aggregate(filter({a}, {_IN}), {empty}, {add}), {less}))"


def _block(both: str, at: int) -> str:
    """Four cells, from one on, of the difference table of two digest arrays, given as one array: without counts, as what both have cancels."""
    add = "(t, d) -> named_struct('k', t.k ^ d, 'c', t.c ^ xxhash64(d))"
    return f"transform(array({', '.join(_CELL[at : at + 4])}), i -> aggregate(filter({both}, {_IN}), named_struct('k', 0L, 'c', 0L), {add}))"


def _split(both: str, a: str, b: str, rung: int) -> str:
    """Weight of the digests in one of two arrays (a, b) only, of those in ``both``: eight tables, each split further if it can't be peeled.

    A table's blocks are made one by one, and all of it only if none names its digests.
    The last size compares what is left of one table as it is: two digests would have to agree in 15 bits, and in all their cells.
    """
    mine, s = f"m{rung}", f"s{rung}"
    ma, mb = f"array_intersect({a}, {mine})", f"array_intersect({b}, {mine})"
    blocks = ", ".join(named(_block(mine, at)) for at in range(0, CELLS, 4))
    table = _let("ma", ma, _let("mb", mb, decided(_both("ma", "mb"))))
    last = f"{weight(f'array_except({ma}, {b})')} + {weight(f'array_except({mb}, {a})')}"
    larger = _split(mine, a, b, rung + 1) if rung < RUNGS else last
    one = f"if(size({mine}) = 0, 0L, coalesce({blocks}, {table}, {larger}))"
    return f"aggregate({_parts(rung)}, 0L, (w{rung}, {s}) -> w{rung} + {_let(mine, _part(both, rung, s), one)})"


def differing(small_a: str, small_b: str, large_a: str, large_b: str, ds_a: str, ds_b: str) -> str:
    """Weight of the digests in one version only, peeled from 12 cells, else from eight tables, else from as many as it takes."""
    first = decided(difference(small_a, small_b))
    pairs = f"zip_with({large_a}, {large_b}, (t, u) -> {difference('t', 'u')})"
    again = _let("m0", _part("every", 0, "s0"), _split("m0", ds_a, ds_b, 1))
    each = f"zip_with({pairs}, {_parts(0)}, (t, s0) -> coalesce({decided('t')}, {again}))"
    second = _let("every", f"concat({ds_a}, {ds_b})", f"aggregate({each}, 0L, (w, x) -> w + x)")
    return f"coalesce({first}, {second})"


def likeness(differ: str, a: str, b: str) -> Column:
    return F.expr(f"if({a} + {b} = 0, 1.0D, 1.0D - {differ} / CAST({a} + {b} AS DOUBLE))")


def _bucket(key: Column, splits: list[int]) -> Column:
    """How many splits are at most key, found by a two-level search."""
    if not splits:
        return F.lit(0)
    step = max(1, int(len(splits) ** 0.5))
    parts = [splits[i : i + step] for i in range(0, len(splits), step)]
    heads = F.array(*[F.lit(p[0]) for p in parts])
    inner = F.array(*[F.array(*[F.lit(x) for x in p]) for p in parts])
    at = F.size(F.filter(heads, lambda h: h <= key))
    within = F.size(F.filter(F.element_at(inner, F.greatest(at, F.lit(1))), lambda s: s <= key))
    return F.when(at == 0, F.lit(0)).otherwise((at - 1) * step + within)


def with_successor(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """docs (key, text, ...) plus bucket, place, successor (the next text) and extra.

    Rows marked ``extra`` are the copies of a bucket's first document at the end of the bucket before.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("key", [i / buckets for i in range(1, buckets)], 20 * buckets).alias("q")).first()["q"] or []
    splits = sorted(set(cuts))
    # one row a bucket comes to the driver
    firsts = {r["b"]: r["first"] for r in docs.groupBy(_bucket(F.col("key"), splits).alias("b")).agg(F.min("key").alias("first")).collect()}
    order = sorted(firsts)
    before = {firsts[b]: order[i - 1] for i, b in enumerate(order)}
    keys = sorted(before)
    plain = F.struct(_bucket(F.col("key"), splits).alias("bucket"), F.lit(False).alias("extra"))
    if keys:
        target = F.element_at(F.array(*[F.lit(before[k]) for k in keys]), F.size(F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: k <= F.col("key"))))
        copies = F.when(F.col("key").isin(keys), F.array(plain, F.struct(target.alias("bucket"), F.lit(True).alias("extra")))).otherwise(F.array(plain))
    else:
        copies = F.array(plain)
    rows = docs.withColumn("at", F.explode(copies)).select(*docs.columns, "at.bucket", "at.extra")
    w = Window.partitionBy("bucket").orderBy("extra", "key", "text")
    return rows.withColumn("place", F.row_number().over(w)).withColumn("successor", F.coalesce(F.lead("text").over(w), F.lit("")))


def versions(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """The op's columns for docs with doc_id and text: each document against its edit and its successor."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), text_or_empty().alias("text"))
    rows = with_successor(base, buckets).withColumn("n_chars", F.length("text").cast("long"))
    edit = "concat(substr(text, 1, CAST(n_chars - n_chars div 4 AS INT)), substr(successor, 1, CAST(n_chars div 4 AS INT)))"
    rows = rows.withColumn("edited", F.expr(f"if(extra, '', {edit})")).drop("successor")
    rows = rows.select("doc_id", "key", "bucket", "extra", "place", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digests("text").alias("da"), digests("edited").alias("de"))
    rows = rows.withColumn("la", subtables("da")).withColumn("le", subtables("de"))
    rows = rows.withColumn("sa", folded("la")).withColumn("se", folded("le")).withColumn("wa", F.expr(weight("da"))).withColumn("we", F.expr(weight("de")))
    w = Window.partitionBy("bucket").orderBy("place")
    lead = {f"{c[0]}n": F.lead(c).over(w) for c in ("da", "la", "sa", "wa")}
    rows = rows.withColumns(lead).where("NOT extra")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint("sa").alias("fingerprint"),
        fingerprint("se").alias("edited_fingerprint"),
        likeness(differing("sa", "se", "la", "le", "da", "de"), "wa", "we").alias("near_edited"),
        likeness(differing("sa", "sn", "la", "ln", "da", "dn"), "wa", "wn").alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(documents(spark, sf_dir))
