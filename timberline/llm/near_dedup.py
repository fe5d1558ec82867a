"""Near-dedup by exact Jaccard similarity of word shingles: op 6's form for a similarity instead of bits.

Two texts link if their sets of 5-word shingles (lower-cased, by 64-bit hash) have a Jaccard similarity
of at least 4/5. Equal sets are one node, named by a hash of the set.

SimHash goes first: a node's fingerprint is the bitwise majority of its set, pigeonring chains find the fingerprints
within op 6's bits of each other, and what they link is counted in full. As similar sets may differ in more bits, candidates for
what is not connected by then come from prefixes: in one order of all shingles, sets that are similar enough share one of the first n - ceil(4/5 n) + 1 of
their n, so no pair is lost. The order puts shingles that a sample of the texts has often behind
all others, so that quoted passages make no hot keys; a poor sample costs time, not links. Pairs whose
sizes or places in both sets leave too few shingles to share are skipped, and so are those whose sketches
(a bit a bin: whether it holds an odd number of the set) differ in more bits than similar sets have
differing shingles; the others are counted in full.

Pairs of prefixes come in two rounds, so that a group of near copies isn't compared pair by pair: first each node of a key with the
key's first and with the one before it, then, of what that leaves unconnected, every pair of one key. Sets are made
from the texts again where they are needed rather than stored; a task sends each node once, however many copies it reads.

A text of fewer words than a shingle is one shingle; null and wordless texts have the empty set and link
with each other only. Repeated rows share their node. An empty table gives no rows. Helper columns are made on
narrow tables of our own, so columns of docs may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm.common import discard, materialize, text_or_empty
from timberline.llm.components import components
from timberline.llm.simhash import majority, near_links

SHINGLE = 5
#: the similarity as a fraction
ABOVE, BELOW = 4, 5
HASH_SEED = 42
SAMPLE = 8192
SAMPLE_SHARE = 1 / 32
OFTEN = 3
HOT = 100_000
FLUSH = 1 << 20
#: what a task remembers of the nodes that it has sent; bits of the table of nodes whose sets are wanted
SEEN, SLOTS = 1 << 20, 1 << 24


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted set of shingle hashes of a UTF-8 text."""
    import xxhash

    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hash64 = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([hash64(joined, HASH_SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[: n - shingle].tolist()]
    return np.unique(np.array([hash64(joined[a:b], HASH_SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64))


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of two bins or more a shingle; halves of it by XOR give the sketch of half as many bins."""
    bins = max(64, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """At most the number of shingles that only one of two sketched sets has."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(text_or_empty().cast("binary").alias("t"))


def _digest() -> Column:
    """What tells texts apart; empty for a null."""
    text = F.col("text").cast("string")
    return F.when(text.isNull(), F.lit(b"")).otherwise(F.unhex(F.md5(text.cast("binary"))))


class _Once:
    """Which nodes a task meets for the first time, by a memory of bounded size."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, nodes: list[int]) -> np.ndarray:
        if len(self.seen) > SEEN:
            self.seen.clear()
        out = np.zeros(len(nodes), bool)
        for i, x in enumerate(nodes):
            if x not in self.seen:
                self.seen.add(x)
                out[i] = True
        return out


def _sets(texts: pa.Array, shingle: int) -> tuple[list[np.ndarray], np.ndarray]:
    import xxhash

    sets = [shingles(t, shingle) for t in texts.to_pylist()]
    return sets, np.array([xxhash.xxh64_intdigest(s.tobytes(), HASH_SEED) for s in sets], np.uint64).view(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))


def node_rows(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, digest, node (a hash of the set) of every row; size, sketch and SimHash where a task first meets a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for part in _parts(batches):
            sets, node = _sets(part.column(2), shingle)
            first = once(node.tolist())
            size = pa.array([len(s) if f else None for s, f in zip(sets, first)], pa.int64())
            brief = pa.array([sketch(s) if f else None for s, f in zip(sets, first)], pa.binary())
            bits = pa.array(np.array([majority(s) if f else 0 for s, f in zip(sets, first)], np.uint64).view(np.int64), mask=~first)
            yield pa.record_batch([part.column(0), part.column(1), pa.array(node), size, brief, bits], ["doc_id", "digest", "node", "n", "sketch", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), text_or_empty().cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, digest binary, node long, n long, sketch binary, fp long")


def often(docs: DataFrame, shingle: int = SHINGLE) -> dict[int, int]:
    """Shingles that several texts of a sample have, with how many: HOT of them at most."""
    share = max(SAMPLE_SHARE, SAMPLE / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for part in _parts(batches):
            sets, node = _sets(part.column(0), shingle)
            for x in (s for s, f in zip(sets, once(node.tolist())) if f):
                yield pa.record_batch([pa.array(x.view(np.int64))], ["key"])

    texts = sample.select(text_or_empty().cast("binary").alias("t")).distinct()
    counted = texts.mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    return {r["key"]: r["n"] for r in counted.orderBy(F.desc("n"), "key").limit(HOT).collect()}


def prefix_rows(docs: DataFrame, hot: dict[int, int], shingle: int = SHINGLE) -> DataFrame:
    """key, node, at: each set's prefix; ``at`` has the set's size in the high, the place in the low 32 bits."""
    keys = np.array(sorted(hot), np.int64)
    counts = np.array([hot[k] for k in keys.tolist()], np.int64)

    def prefix(values: np.ndarray) -> np.ndarray:
        size = len(values) + ABOVE * -len(values) // BELOW + 1
        if len(keys):
            found = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
            rank = np.where(keys[found] == values, counts[found], 0)
            if rank.any():
                return values[np.lexsort((values, rank))[:size]]
        return np.sort(values)[:size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for part in _parts(batches):
            sets, nodes = _sets(part.column(0), shingle)
            picked = [(prefix(x.view(np.int64)), n, len(x)) for x, n, f in zip(sets, nodes.tolist(), once(nodes.tolist())) if f and len(x)]
            if picked:
                out, node, at = np.concatenate([p for p, _, _ in picked]), np.repeat([n for _, n, _ in picked], [len(p) for p, _, _ in picked]), np.concatenate([np.arange(len(p)) + (n << 32) for p, _, n in picked])
                yield pa.record_batch([pa.array(out), pa.array(node), pa.array(at)], ["key", "node", "at"])

    return _text(docs).mapInArrow(run, "key long, node long, at long")


def fits(at: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether two sets that share the shingle at these places can have the similarity, shingles before it left out."""
    size, left = at >> 32, (at >> 32) - (at & 0xFFFFFFFF)
    size2, left2 = other >> 32, (other >> 32) - (other & 0xFFFFFFFF)
    need = -(-ABOVE * (size + size2) // (ABOVE + BELOW))
    return (left >= need) & (left2 >= need)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole keys' rows (sorted by key), a batch or more at a time."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [np.array(c, np.int64) for c in batch.columns]
        if held and now[0][-1] == held[0][0][0]:
            held.append(now)
            continue
        columns = [np.concatenate(c) for c in zip(*held, now)]
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        if last:
            yield [c[:last] for c in columns]
        held = [[c[last:] for c in columns]]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def shared_rows(rows: DataFrame) -> DataFrame:
    """The rows whose key several nodes have, with the key's first node and the one before, where they may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, at in _groups(batches):
            fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
            key, node, at = key[fresh], node[fresh], at[fresh]
            first = np.r_[True, key[1:] != key[:-1]]
            begin = np.flatnonzero(first)
            size = np.diff(np.r_[begin, len(key)])
            several = np.repeat(size > 1, size)
            head, prev = np.repeat(begin, size), np.maximum(np.arange(len(key)) - 1, 0)
            near = [np.where(~first & fits(at, at[x]), node[x], node) for x in (head, prev)]
            yield pa.record_batch([pa.array(c[several]) for c in (key, node, at, *near)], ["key", "node", "at", "head", "prev"])

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long, at long, head long, prev long")


def cross_pairs(key: np.ndarray, label: np.ndarray, node: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows sorted by key and label: pairs of one key and two labels that may be similar, some FLUSH at a time."""
    n = len(key)
    change = np.r_[True, (key[1:] != key[:-1]) | (label[1:] != label[:-1])]
    begin = np.flatnonzero(change)
    until = np.repeat(np.r_[begin[1:], n], np.diff(np.r_[begin, n]))  # where a row's label ends
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    end = np.repeat(np.r_[begin[1:], n], np.diff(np.r_[begin, n]))
    row, low = np.arange(n), until
    while len(row):
        some = np.minimum(end[row] - low, FLUSH)
        total = np.cumsum(some)
        now = max(1, int(np.searchsorted(total, FLUSH, side="right")))
        a, take = row[:now], some[:now]
        i = np.repeat(a, take)
        j = np.repeat(low[:now] - np.cumsum(take) + take, take) + np.arange(take.sum())
        ok = fits(at[i], at[j])
        if ok.any():
            u, v = node[i[ok]], node[j[ok]]
            yield tuple(np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1))
        more = low[:now] + take < end[a]
        row, low = np.r_[a[more], row[now:]], np.r_[(low[:now] + take)[more], low[now:]]


def candidates(labelled: DataFrame) -> DataFrame:
    """u, v: distinct pairs of nodes that share a key, may be similar and have two labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _groups(batches):
            for u, v in cross_pairs(*columns):
                yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    return labelled.select("key", "label", "node", "at").repartition("key").sortWithinPartitions("key", "label").mapInArrow(run, "u long, v long").distinct()


def sketched(pairs: DataFrame, brief: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sketches let them have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 4096):
            sizes, a, b = np.array(batch.column(2), np.int64), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            differ = np.fromiter(map(apart, a, b), np.int64, len(a))
            yield batch.select([0, 1]).filter(pa.array((ABOVE + BELOW) * differ <= (BELOW - ABOVE) * sizes))

    u, v = (brief.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "uv")
    joined = pairs.join(u, "u").join(v, "v").select("u", "v", (F.col("nu") + F.col("nv")).cast("long").alias("n"), "su", "sv")
    return joined.mapInArrow(run, "u long, v long")


def by_bits(brief: DataFrame) -> DataFrame:
    """u, v: pairs of nodes that connect all whose fingerprints SimHash links; nodes of one fingerprint meet at the least of them."""
    own = brief.select("node", "fp")
    least = own.groupBy("fp").agg(F.min("node").alias("least"))
    equal = own.join(least, "fp").where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    a, b = (least.select(F.col("fp").alias(c), F.col("least").alias(f"of_{c}")) for c in "uv")
    across = near_links(least.select("fp")).join(a, "u").join(b, "v")
    return equal.unionByName(across.select(F.least("of_u", "of_v").alias("u"), F.greatest("of_u", "of_v").alias("v"))).distinct()


def apart_yet(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """The pairs (u, v) that are not connected."""
    u, v = (member.select(F.col("node").alias(c), F.col("component").alias(f"in_{c}")) for c in "uv")
    joined = pairs.join(u, "u", "left").join(v, "v", "left")
    return joined.where(F.coalesce("in_u", "u") != F.coalesce("in_v", "v")).select("u", "v")


def wanted_slots(nodes: DataFrame) -> np.ndarray:
    """A bit a slot: whether a node falls there; SLOTS / 8 bytes come to the driver, whatever the table's size."""
    at = F.pmod("node", F.lit(SLOTS)) + 1
    found = nodes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(SLOTS, bool)
    for r in found:
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little").astype(bool)
        low = (r["b"] - 1) * len(bits)
        out[low : low + len(bits)] = bits[: SLOTS - low]
    return out


def sets_of(docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """node, shingles of the wanted nodes, made from the texts again; a table of bits sorts most others out in the task."""
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted_slots(nodes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, packed = _Once(), bits.value
        for part in _parts(batches):
            sets, node = _sets(part.column(0), shingle)
            slot = node % SLOTS
            asked = (packed[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1
            mine = [i for i, f in enumerate(once(node.tolist())) if f and asked[i]]
            if mine:
                yield pa.record_batch([pa.array(node[mine]), pa.array([sets[i].view(np.int64) for i in mine], pa.list_(pa.int64()))], ["node", "shingles"])

    made = _text(docs).mapInArrow(run, "node long, shingles array<long>")
    return made.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def similar(pairs: DataFrame, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (u, v) whose sets have the similarity."""
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    picked = materialize(sets_of(docs, nodes, shingle), "picked")
    u, v = (picked.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "uv")
    both = F.size(F.array_intersect("of_u", "of_v"))
    found = pairs.join(u, "u").join(v, "v").where((ABOVE + BELOW) * both >= ABOVE * (F.size("of_u") + F.size("of_v")))
    out = materialize(found.select("u", "v"), "similar")
    discard(picked)
    return out


def grouped(docs: DataFrame, own: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """node, component for the nodes that are similar to another."""
    brief = materialize(own.where("sketch is not null").select("node", "n", "sketch", "fp").dropDuplicates(["node"]), "brief")
    near = materialize(sketched(by_bits(brief), brief), "near")
    links = near if near.isEmpty() else similar(near, docs, shingle)
    member = components(links)
    shared = materialize(shared_rows(prefix_rows(docs, often(docs, shingle), shingle)), "shared")
    stars = F.explode(F.array(*[F.struct(F.least("node", c).alias("u"), F.greatest("node", c).alias("v")) for c in ("head", "prev")])).alias("p")
    first = shared.select(stars).select("p.*").where("u <> v").distinct()
    links = links.unionByName(similar(materialize(sketched(apart_yet(first, member), brief), "sketched"), docs, shingle))
    member = components(links)
    labelled = shared.join(member.select(F.col("node").alias("m"), "component"), F.col("node") == F.col("m"), "left").withColumn("label", F.coalesce("component", "node"))
    rest = materialize(sketched(candidates(labelled), brief), "crossed")
    if not rest.isEmpty():
        member = components(links.unionByName(similar(rest, docs, shingle)))
    for df in (brief, shared, rest):
        discard(df)
    return member


def _components(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, digest, component (a node) of every row."""
    own = materialize(node_rows(docs, shingle), "nodes")
    member = grouped(docs, own, shingle)
    # nodes are many rows only where texts repeat: one row a node is joined, with null for a node of its own
    joined = own.join(member.select(F.col("node").alias("m"), "component"), F.col("node") == F.col("m"), "left")
    return materialize(joined.select("doc_id", "digest", F.coalesce("component", "node").alias("component")), "components")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, component_id (the group's least doc_id) for every row of docs."""
    rows = _components(docs, shingle)
    tops = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(tops, "component").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Of each group one row of docs: that of least doc_id (nulls last), then of least text digest; of rows that share both, one.

    Rows of different groups never displace each other, whatever their doc_ids.
    """
    key = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "digest")
    rows = _components(docs, shingle).groupBy("component").agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("rows"))
    kept = rows.select(F.struct(F.col("k.doc_id").alias("id"), F.col("k.digest").alias("digest"), (F.col("rows") > 1).alias("several")).alias("near_dedup_kept"))
    # the digest spreads rows without a doc_id; names of docs are out of the way in a struct
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("near_dedup_row"), F.col("doc_id").cast("long").alias("id"), _digest().alias("digest"))
    k = F.col("near_dedup_kept")
    joined = mine.join(kept, F.col("id").eqNullSafe(k["id"]) & (F.col("digest") == k["digest"]))
    alone = joined.where(~k["several"]).select("near_dedup_row.*")
    # groups of several rows may hold repeats of the row that stays: its least copy, by partial aggregates
    repeats = joined.where(k["several"])
    if any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in docs.schema.fields):
        one = repeats.dropDuplicates(["id", "digest"])
    else:
        one = repeats.groupBy("id", "digest").agg(F.min("near_dedup_row").alias("near_dedup_row"))
    return alone.unionByName(one.select("near_dedup_row.*"))
