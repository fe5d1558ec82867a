"""Packing by Karmarkar-Karp multiway differencing.

Each document (its ids and a closing id) gives full windows and a remainder cut
into small pieces; cuts depend on the document alone, so one pass over the texts
yields every piece with its checksum. Pieces are dealt to buckets by hash, and in
each bucket runs of pieces are spread over a few windows: partial partitions are
merged largest imbalance first, the fullest window of one with the emptiest of
the other. When the fullest exceeds the capacity, the window count rises.

Null texts count as empty: a document is then the closing id alone. Repeated rows
are packed each. Buckets are about equally large whatever the documents' lengths
and sources are, and none is larger than a parameter on average.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import documents, materialize, text_or_empty
from timberline.llm.tokens import default_tokenizer, encoder

CAPACITY = 2048
GRAIN = 256
WINDOWS = 32
FILL = 0.993
BUCKET_PIECES = 40_000
END = (1).to_bytes(4, "little")
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cuts(n: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: full windows, then grains."""
    full = n // capacity * capacity
    return [(s, capacity) for s in range(0, full, capacity)] + [(s, min(grain, n - s)) for s in range(full, n, grain)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, grain: int = GRAIN, forget: bool = False) -> DataFrame:
    """One row per piece, with the checksum of its ids; ``forget``: tasks leave no memo of words in their workers, where other stages follow."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_words = encoder(tokenizer)
        names = [x.split()[0] for x in PIECE.split(", ")]
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part, rows = batch.slice(at, 256), []
                    for doc, ids in zip(part.column(0).to_pylist(), of_words.ids(part.column(1).to_pylist())):
                        ids += END
                        n = len(ids) // 4
                        rows += [(doc, s, k, zlib.crc32(ids[4 * s : 4 * (s + k)]), n) for s, k in cuts(n, capacity, grain)]
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, names)
        finally:
            if forget:
                of_words.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("t")).mapInArrow(cut, PIECE)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: k lists of positions in sizes, of near-equal sums.

    A partial partition is its non-empty parts, ascending, as (sum, first position, members); the rest of
    its k parts are empty. Members nest until the end.
    """
    heap: list[tuple[int, int, list[tuple]]] = [(-v, i, [(v, i, i)]) for i, v in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, at, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        # the fullest of b go to the emptiest of a: first its empty parts, then the least
        alone = min(len(b), k - len(a))
        n = len(b) - alone
        merged = [(x[0] + y[0], x[1], (x[2], y[2])) for x, y in zip(a, reversed(b[:n]))]
        merged += a[n:]
        merged += b[n:]
        merged.sort()
        least = merged[0][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[-1][0], at, merged))
    out = []
    for _, _, members in heap[0][2] if heap else []:
        flat, todo = [], [members]
        while todo:
            x = todo.pop()
            if isinstance(x, int):
                flat.append(x)
            else:
                todo.extend(x)
        out.append(sorted(flat))
    return out + [[]] * (k - len(out))


def spread(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most capacity over sizes (none above capacity), as few as differencing finds."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return [w for w in windows if w]
        k += 1


def pack(rows: DataFrame, capacity: int = CAPACITY, windows: int = WINDOWS, fill: float = FILL, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """Adds sequence_id and offset to materialized pieces."""
    buckets = max(1, -(-rows.count() // bucket_pieces))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def of_bucket(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start", "length", "ids_crc32")])
        sizes = table.column("length").to_pylist()
        ids, offsets, following = [0] * len(sizes), [0] * len(sizes), key[0].as_py() << 32
        group: list[int] = []
        total = 0

        def close() -> None:
            nonlocal following, total
            for w in spread([sizes[i] for i in group], capacity):
                at = 0
                for i in w:
                    ids[group[i]], offsets[group[i]] = following, at
                    at += sizes[group[i]]
                following += 1
            group.clear()
            total = 0

        for i, v in enumerate(sizes):
            if v == capacity:
                ids[i], following = following, following + 1
                continue
            if group and total + v > windows * capacity * fill:
                close()
            group.append(i)
            total += v
        if group:
            close()
        out = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return out.append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return rows.groupBy("bucket").applyInArrow(of_bucket, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, forget: bool = False) -> DataFrame:
    return pack(materialize(pieces(docs, tokenizer or default_tokenizer(), forget=forget), "pieces"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
