"""SimHash near-dedup with pigeonring candidate filtering.

A fingerprint is the bitwise majority of the XXH64 hashes of 4-word shingles.
Two fingerprints link at ``LIMIT`` or fewer differing bits. Equal fingerprints are one
node. The 64 bits form a ring of five segments; if two fingerprints differ in at most 4 bits,
then from some segment on every chain of l consecutive segments differs in at most
l * 4 / 5 bits: the first in none, two in at most 1, three in at most 2, four in at most 3. The first
two segments are the join key: of two fingerprints that differ in one bit of the second
segment, the one with the 0 also emits the key with a 1. Keys with very many rows go on to
chains of three (38 or 39 known bits), and those with very many there to chains of four, whose 51 or 52 known bits
leave 2^13 nodes a group at most. Survivors get the full Hamming
check; rows that are connected already are not compared again, and each task emits a spanning forest of its links, not all pairs.

Null and wordless texts have fingerprint zero and link like any other. Repeated rows
share their node. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import documents, materialize, text_or_empty
from timberline.llm.components import components

SHINGLE = 4
HASH_SEED = 42
LIMIT = 4
WIDTHS = (13, 13, 13, 13, 12)
OFFSETS = (0, 13, 26, 39, 52)
HOT = 50_000


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    total, counts = len(hashes), np.zeros(64, np.int64)
    array = hashes.astype(">u8")
    for at in range(0, total, 1 << 16):
        counts += np.unpackbits(array[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    import xxhash

    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    hash64 = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= shingle:
        hashes = [hash64(joined, HASH_SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = [0, *ends[: n - shingle].tolist()]
        hashes = [hash64(joined[a:b], HASH_SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    return majority(np.array(hashes, np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps: list[int] = []
            for at in range(0, batch.num_rows, 512):
                fps += [fingerprint(t, shingle) for t in batch.column(1).slice(at, 512).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def _flips(widths: list[int], most: list[int], used: int = 0) -> Iterator[int]:
    """Masks over consecutive segments (the last in the low bits): all ways to flip bits within the cumulative budgets."""
    if not widths:
        yield 0
        return
    rest = sum(widths[1:])
    for k in range(most[0] - used + 1):
        for bits in combinations(range(widths[0]), k):
            own = sum(1 << b for b in bits) << rest
            for more in _flips(widths[1:], most[1:], used + k):
                yield own | more


def chain_rows(fps: np.ndarray, chain: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(keys, fingerprints, probe) of the chain filter: index rows, then probes one flip or more away."""
    for i in range(5):
        at = [(i + j) % 5 for j in range(chain)]
        seg = [(fps >> np.uint64(OFFSETS[a])) & np.uint64((1 << WIDTHS[a]) - 1) for a in at]
        base = np.uint64(i)
        key = np.full(len(fps), base, np.uint64)
        for a, s in zip(at, seg):
            key = (key << np.uint64(WIDTHS[a])) | s
        yield key, fps, False
        if chain == 2:
            for b in range(WIDTHS[at[1]]):
                zero = (seg[1] >> np.uint64(b)) & np.uint64(1) == 0
                yield key[zero] | np.uint64(1 << b), fps[zero], True
        else:
            for mask in _flips([WIDTHS[a] for a in at[1:]], [j * LIMIT // 5 for j in range(2, chain + 1)]):
                if mask:
                    yield key ^ np.uint64(mask), fps, True


def _keyed(nodes: DataFrame, chain: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fps = np.array(batch.column(0).slice(at, 20_000), np.int64).view(np.uint64)
                for key, fp, probe in chain_rows(fps, chain):
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), probe))], ["key", "fp", "probe"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long, probe boolean")


def group_links(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key: pairs with one key, at most one of them a probe, within limit bits; a spanning forest of them.

    Memory is that of the rows: a label a row says what it is connected to, and pairs of one label are passed over.
    """
    n = len(key)
    label, out_u, out_v = np.arange(n), [], []
    live, shift = np.flatnonzero(key[1:] == key[:-1]), 1
    while len(live):
        a = live[label[live] != label[live + shift]]
        b = a + shift
        ok = (np.bitwise_count(fp[a] ^ fp[b]) <= limit) & ~(probe[a] & probe[b])
        if ok.any():
            a, b = a[ok], b[ok]
            root: dict[int, int] = {}

            def find(x: int, root: dict[int, int] = root) -> int:
                while (p := root.get(x, x)) != x:
                    root[x] = x = root.get(p, p)
                return x

            used = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(label[a].tolist(), label[b].tolist())):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    used[i] = True
            to = np.arange(n)
            for x in list(root):
                to[x] = find(x)
            label = to[label]
            a, b = a[used], b[used]
            different = fp[a] != fp[b]
            out_u.append(fp[a[different]])
            out_v.append(fp[b[different]])
        shift += 1
        live = live[live + shift < n]
        live = live[key[live] == key[live + shift]]
    if not out_u:
        return np.array([], np.uint64), np.array([], np.uint64)
    return np.concatenate(out_u), np.concatenate(out_v)


def _links(rows: DataFrame, hot: int | None) -> DataFrame:
    """u, v links; with ``hot``, groups of more rows come back as (fp, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, probe = np.array([], np.int64), np.array([], np.uint64), np.array([], bool)
        burning = None

        def links(u: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
            second = pa.nulls(len(u), pa.int64()) if v is None else pa.array(v.view(np.int64))
            return pa.record_batch([pa.array(u.view(np.int64)), second], ["u", "v"])

        def closed(k: np.ndarray, f: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
            if hot and len(k):
                starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                sizes = np.diff(np.r_[starts, len(k)])
                big = np.repeat(sizes > hot, sizes)
                if big.any():
                    yield links(f[big & ~p], None)
                    yield links(f[big & p], None)
                    k, f, p = k[~big], f[~big], p[~big]
            if len(k):
                u, v = group_links(k, f, p)
                if len(u):
                    yield links(u, v)

        for batch in batches:
            k2 = np.array(batch.column(0), np.int64)
            f2, p2 = np.array(batch.column(1), np.int64).view(np.uint64), np.array(batch.column(2))
            if burning is not None and len(k2):
                same = k2 == burning
                if same.any():
                    yield links(f2[same], None)
                    k2, f2, p2 = k2[~same], f2[~same], p2[~same]
                if len(k2):
                    burning = None
            key, fp, probe = np.r_[key, k2], np.r_[fp, f2], np.r_[probe, p2]
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            yield from closed(key[:last], fp[:last], probe[:last])
            key, fp, probe = key[last:], fp[last:], probe[last:]
            if hot and len(key) > hot:
                burning = key[0]
                yield links(fp, None)
                key, fp, probe = key[:0], fp[:0], probe[:0]
        yield from closed(key, fp, probe)

    return rows.mapInArrow(run, "u long, v long")


def near_links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v) links that connect all nodes (column fp) within LIMIT bits of each other."""

    def pairs(of: DataFrame, chain: int, most: int | None) -> DataFrame:
        return _links(_keyed(of, chain).repartition("key").sortWithinPartitions("key"), most)

    found = materialize(pairs(nodes, 2, hot), "pairs")
    links = found.where("v is not null")
    for chain in (3, 4):
        burnt = found.where("v is null").select(F.col("u").alias("fp")).distinct()
        if burnt.isEmpty():
            break
        found = materialize(pairs(burnt, chain, hot if chain == 3 else None), f"pairs{chain}")
        links = links.unionByName(found.where("v is not null"))
    return links


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    own = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    member = components(near_links(nodes, hot))
    named = nodes.join(member, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = materialize(named, "members")
    tops = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return own.join(named.join(tops, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One row of docs of each near-duplicate group, the others dropped; see ``near_dedup.keep_one`` for which.

    With a similarity (0.8 is what there is) groups are by the exact Jaccard similarity of shingle sets. Links of fingerprints by
    ``near_links`` are verified first; no bound on differing bits says the same as the similarity, so set prefixes give those beyond it.
    """
    from timberline.llm import near_dedup

    if similarity is None:
        raise ValueError("groups by bits have no rows to keep: use near_duplicates")
    if round(similarity * near_dedup.BELOW) != near_dedup.ABOVE:
        raise ValueError(f"similarity {similarity} isn't {near_dedup.ABOVE}/{near_dedup.BELOW}")
    return near_dedup.keep_one(docs, shingle)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
