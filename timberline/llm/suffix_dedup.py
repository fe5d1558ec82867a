"""Suffix-array dedup: a distributed, common-prefix-aware merge sort of suffixes.

A byte is removed if a 50-byte string that covers it also starts in a document with a smaller
doc_id. Not all suffixes need sorting for that: of the 24-byte strings in each 50-byte window one
with the least hash is the window's anchor, and equal windows have the same anchor. So suffixes that start
at anchors (about 7 % of the bytes) are sorted, and among them only those whose anchor occurs in two documents.

1. Texts are laid down in blocks in the shared folder; each block sends the sorted, delta-coded
   hashes of its anchors by hash range, and gets back those that another block has, too.
2. Each block sorts the suffixes at these anchors (50 bytes, then up to 26 bytes before the anchor,
   backwards), keeps one of equal ones with its least doc_id, and sends sorted runs, front-coded:
   the length of the common prefix with the suffix before, and the rest.
3. Each range merges its runs with a loser tree that carries common prefix lengths: unequal lengths
   decide without looking at the bytes, equal ones compare from there on. The lengths that come out
   delimit groups of one anchor and tell which windows two different suffixes can share; such
   windows get the least doc_id by their bytes.
4. Anchors that occur very often (blocks report those they have many of, ranges add up) are left out
   of the runs: their windows, one of equal ones a block, are aggregated by 128-bit digest, so no task
   merges more suffixes of one anchor than a bound that doesn't grow with the data.
5. Blocks turn the answers into spans of their documents.

Recomputed tasks write the same block files under the same names. Null texts are empty. Null doc_ids are larger
than all others; rows with equal doc_ids don't remove from each other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import documents, materialize, scratch, text_or_empty

LENGTH = 50
GRAM = 24
LEFT = LENGTH - GRAM
WIDTH = LENGTH + LEFT
BLOCK_BYTES = 16_000_000
HOT_CLASSES = 20_000
HOT_ANCHORS = 20_000
HEAVY = 32
RANGES_PER_PART = 3
PIECE = 1 << 18
PAD = 0xFF
NULL_ID = 2**63 - 1
C0, C1, C2, C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_CODEC = "zstd"


# --- the shared folder -------------------------------------------------------------------


def _store(base: str) -> tuple[pafs.FileSystem, str]:
    if "://" in base or base.startswith("file:"):
        return pafs.FileSystem.from_uri(base)
    return pafs.LocalFileSystem(), base


def _save(base: str, name: str, **arrays: np.ndarray) -> None:
    """Writes arrays under a name; a repeated write leaves the same content."""
    store, path = _store(base)
    store.create_dir(path, recursive=True)
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    packed = pa.Codec(_CODEC).compress(buffer.getvalue())
    context = TaskContext.get()
    own = f"{path}/.{name}-{context.taskAttemptId() if context else 0}"
    with store.open_output_stream(own) as out:
        out.write(np.array([buffer.tell()], "<i8").tobytes())
        out.write(packed)
    store.move(own, f"{path}/{name}")


def _load(base: str, name: str) -> dict[str, np.ndarray]:
    store, path = _store(base)
    with store.open_input_stream(f"{path}/{name}") as f:
        size = int(np.frombuffer(f.read(8), "<i8")[0])
        raw = pa.Codec(_CODEC).decompress(f.read(), size)
    with np.load(io.BytesIO(raw)) as found:
        return {k: found[k] for k in found.files}


# --- anchors -----------------------------------------------------------------------------


def _grams(buf: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings of buf."""
    n = len(buf) - 7
    word = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        m = (len(buf) - o) // 8
        word[o::8] = np.frombuffer(buf, "<u8", count=m, offset=o)[: len(word[o::8])]
    m = len(buf) - GRAM + 1
    h = word[:m] * C0
    h ^= h >> np.uint64(32)
    h += word[8 : 8 + m]
    h *= C1
    h ^= h >> np.uint64(29)
    h += word[16 : 16 + m]
    h *= C2
    h ^= h >> np.uint64(32)
    return h


def anchors(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places in the texts [starts, ends) of one buffer, their 40-bit hashes, and which text each is in."""
    found, hashes = [], []
    windows = len(text) - LENGTH + 1
    span = LENGTH - GRAM + 1
    for at in range(0, max(0, windows), PIECE):
        part = np.ascontiguousarray(text[at : min(len(text), at + PIECE + LENGTH - 1)])
        h = _grams(part)
        least = ((h >> np.uint64(32)) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        place = place[np.r_[True, place[1:] != place[:-1]]]
        mixed = (h[place] ^ (h[place] >> np.uint64(31))) * C3
        found.append(place + at)
        hashes.append((mixed >> np.uint64(24)).astype(np.int64))
    if not found:
        return np.array([], np.int64), np.array([], np.int64), np.array([], np.int64)
    place, hashed = np.concatenate(found), np.concatenate(hashes)
    first = np.r_[True, place[1:] != place[:-1]]
    place, hashed = place[first], hashed[first]
    of = np.searchsorted(starts, place, side="right") - 1
    inside = place + GRAM <= ends[of]
    return place[inside], hashed[inside], of[inside]


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 40-bit numbers as 32-bit differences; as they are if one doesn't fit."""
    step = np.diff(values, prepend=0)
    if len(step) and step.max() >= 1 << 32:
        return b"\1" + values.astype("<i8").tobytes()
    return b"\0" + step.astype("<u4").tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if raw[:1] == b"\1":
        return np.frombuffer(raw, "<i8", offset=1)
    return np.cumsum(np.frombuffer(raw, "<u4", offset=1).astype(np.int64))


# --- 1: blocks and shared anchors ----------------------------------------------------------


def _lay_blocks(docs: DataFrame, base: str, ranges: int, block_bytes: int) -> DataFrame:
    """Writes text blocks; returns (range, block, payload) rows of anchor hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        texts: list[bytes] = []
        size, count = 0, 0

        def close() -> pa.RecordBatch:
            nonlocal size, count
            block = part << 24 | count
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            text = np.frombuffer(b"".join(texts), np.uint8)
            _save(f"{base}/text", str(block), text=text, lengths=lengths, ids=np.concatenate(ids))
            ends = np.cumsum(lengths)
            _, hashed, _ = anchors(text, ends - lengths, ends)
            hashed, times = np.unique(hashed, return_counts=True)
            edges = np.searchsorted(hashed, (np.arange(ranges + 1) << 40) // ranges)
            rows = [pack_sorted(hashed[a:b]) for a, b in zip(edges, edges[1:])]
            often = [np.r_[hashed[a:b][times[a:b] >= HEAVY], times[a:b][times[a:b] >= HEAVY]].astype("<i8").tobytes() for a, b in zip(edges, edges[1:])]
            ids.clear()
            texts.clear()
            size, count = 0, count + 1
            return pa.record_batch([pa.array(range(ranges), pa.int32()), pa.array([block] * ranges, pa.int64()), pa.array(rows, pa.binary()), pa.array(often, pa.binary())], ["range", "block", "payload", "often"])

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                piece = batch.slice(at, 128)
                own = piece.column(1).to_pylist()
                texts += own
                ids.append(np.array(piece.column(0).fill_null(NULL_ID), np.int64))
                size += sum(map(len, own))
                if size >= block_bytes:
                    yield close()
        if texts:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("t"))
    return rows.mapInArrow(run, "range int, block long, payload binary, often binary")


def _shared_hashes(table: pa.Table, hot: int) -> pa.Table:
    """For each block of a range, those of its hashes that another block has, and those with ``hot`` or more places in all."""
    blocks = table.column("block").to_pylist()
    arrays = [unpack_sorted(x) for x in table.column("payload").to_pylist()]
    every, times = np.unique(np.concatenate(arrays), return_counts=True)
    twice = every[times >= 2]
    for raw in table.column("often").to_pylist():
        many, count = np.frombuffer(raw, "<i8").reshape(2, -1)
        times[np.searchsorted(every, many)] += count - 1
    burning = every[times >= hot]
    shared = [pack_sorted(own[_member(own, twice)]) for own in arrays]
    often = [pack_sorted(own[_member(own, burning)]) for own in arrays]
    return pa.table({"block": pa.array(blocks, pa.int64()), "payload": pa.array(shared, pa.binary()), "often": pa.array(often, pa.binary())})


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(of):
        return np.zeros(len(values), bool)
    at = np.searchsorted(of, values)
    at[at == len(of)] = 0
    return of[at] == values


# --- 2: sorted runs --------------------------------------------------------------------------


def suffix_rows(text: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each place WIDTH bytes: those from it on, then those before it, backwards; padded past its document."""
    padded = np.concatenate([np.full(LEFT, PAD, np.uint8), text, np.full(LENGTH, PAD, np.uint8)])
    right = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)[place + LEFT]
    left = np.lib.stride_tricks.sliding_window_view(padded, LEFT)[place][:, ::-1]
    out = np.concatenate([right, left], axis=1)
    step = np.arange(LENGTH)
    out[:, :LENGTH][step >= (end - place)[:, None]] = PAD
    out[:, LENGTH:][step[:LEFT] >= (place - start)[:, None]] = PAD
    return out


def spans_of(place: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What all windows around each anchor cover: [from, to), empty if no window fits."""
    left, right = np.minimum(LEFT, place - start), np.minimum(LENGTH, end - place)
    ok = left + right >= LENGTH
    return np.where(ok, place - left, place), np.where(ok, place + right, place)


def hot_windows(text: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Distinct windows around hot anchors (digest halves, least doc_id, number), and what the block remembers of them."""
    at = (place[:, None] - np.arange(LEFT + 1)).ravel()
    ok = (at >= np.repeat(start, LEFT + 1)) & (at + LENGTH <= np.repeat(end, LEFT + 1))
    at, first = np.unique(at[ok], return_index=True)
    doc = np.repeat(doc, LEFT + 1)[ok][first]
    h1, h2 = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for i in range(0, len(at), PIECE):
        part = at[i : i + PIECE]
        cells = np.zeros((len(part), 56), np.uint8)
        cells[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[part]
        words = cells.view("<u8")
        for out, c in ((h1, C1), (h2, C3)):
            h = np.full(len(part), c, np.uint64)
            for k in range(7):
                h = (h ^ words[:, k]) * c
                h ^= h >> np.uint64(29 + (k & 3))
            out[i : i + PIECE] = ((h ^ (h >> np.uint64(32))) * C0).view(np.int64)
    order = np.lexsort((h2, h1))
    at, doc, h1, h2 = at[order], doc[order], h1[order], h2[order]
    fresh = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])][: len(at)]
    number, edge = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    least = np.minimum.reduceat(doc, edge) if len(edge) else doc
    gone, mine = doc > least[number], doc == least[number]
    rows = {"h1": h1[edge], "h2": h2[edge], "doc": least, "number": np.arange(len(edge))}
    return rows, {"wnumber": number[mine], "wplace": at[mine], "gone": at[gone]}


def make_runs(text: np.ndarray, lengths: np.ndarray, ids: np.ndarray, shared: np.ndarray, hot: np.ndarray, ranges: int) -> tuple[list[bytes], dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The block's run for each range, its windows at hot anchors, and what it must remember to use the answers."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    place, hashed, of = anchors(text, starts, ends)
    # an anchor matters if another block has it, or two documents of this one
    order = np.argsort(hashed, kind="stable")
    edge = np.flatnonzero(np.r_[True, hashed[order][1:] != hashed[order][:-1]]) if len(order) else np.array([], np.int64)
    both = np.zeros(len(place), bool)
    if len(order):
        own = ids[of[order]]
        several = np.minimum.reduceat(own, edge) < np.maximum.reduceat(own, edge)
        both[order] = np.repeat(several, np.diff(np.r_[edge, len(order)]))
    burning = _member(hashed, hot)
    x = np.flatnonzero(burning)
    windows, known = hot_windows(text, place[x], starts[of[x]], ends[of[x]], ids[of[x]])
    both = (both | _member(hashed, shared)) & ~burning
    place, hashed, of = place[both], hashed[both], of[both]
    gone = known["gone"].astype(np.int32)
    memory = {"number": np.array([], np.int32), "place": np.array([], np.int32), "a": gone, "b": gone + LENGTH, "wnumber": known["wnumber"].astype(np.int32), "wplace": known["wplace"].astype(np.int32)}
    if not len(place):
        return [b""] * ranges, windows, memory
    rows = suffix_rows(text, place, starts[of], ends[of])
    which = (hashed * ranges) >> 40
    order = np.argsort(rows.reshape(-1).view(f"S{WIDTH}"), kind="stable")
    order = order[np.argsort(which[order], kind="stable")]
    rows, place, of, which = rows[order], place[order], of[order], which[order]
    differs = rows[1:] != rows[:-1]
    lcp = np.r_[0, np.where(differs.any(axis=1), differs.argmax(axis=1), WIDTH)]
    fresh = (lcp < WIDTH) | np.r_[True, which[1:] != which[:-1]]
    fresh[0] = True
    number = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    doc = ids[of]
    least = np.minimum.reduceat(doc, first)
    a, b = spans_of(place, starts[of], ends[of])
    gone = (doc > least[number]) & (b > a)
    mine = doc == least[number]
    memory |= {"number": number[mine].astype(np.int32), "place": place[mine].astype(np.int32), "a": np.r_[memory["a"], a[gone].astype(np.int32)], "b": np.r_[memory["b"], b[gone].astype(np.int32)]}
    rows, lcp, which = rows[first], lcp[first], which[first]
    lcp[np.r_[True, which[1:] != which[:-1]]] = 0
    runs, edges = [], np.searchsorted(which, np.arange(ranges + 1))
    for x, y in zip(edges, edges[1:]):
        if x == y:
            runs.append(b"")
            continue
        rest = rows[x:y][np.arange(WIDTH) >= lcp[x:y, None]]
        raw = np.array([y - x, x], "<i8").tobytes() + least[x:y].astype("<i8").tobytes() + lcp[x:y].astype(np.uint8).tobytes() + rest.tobytes()
        runs.append(np.array([len(raw)], "<i8").tobytes() + pa.Codec(_CODEC).compress(raw).to_pybytes())
    return runs, windows, memory


# --- 3: merging ------------------------------------------------------------------------------


class Run:
    """A front-coded run, read once: current suffix, its common prefix with the one before, its doc_id and number."""

    __slots__ = ("at", "base", "block", "count", "docs", "lcps", "rest", "suffix", "taken")

    def __init__(self, block: int, payload: bytes) -> None:
        raw = pa.Codec(_CODEC).decompress(payload[8:], int(np.frombuffer(payload[:8], "<i8")[0])).to_pybytes()
        self.block = block
        self.count, self.base = (int(x) for x in np.frombuffer(raw[:16], "<i8"))
        self.docs = np.frombuffer(raw, "<i8", self.count, 16).tolist()
        self.lcps = raw[16 + 8 * self.count : 16 + 9 * self.count]
        self.rest = raw[16 + 9 * self.count :]
        self.at, self.taken, self.suffix = -1, 0, b""

    def step(self) -> int:
        """Moves to the next suffix and returns the common prefix length with the last one; -1 at the end."""
        self.at += 1
        if self.at >= self.count:
            return -1
        lcp = self.lcps[self.at]
        taken = self.taken
        self.taken = taken + WIDTH - lcp
        self.suffix = self.suffix[:lcp] + self.rest[taken : self.taken]
        return lcp


def extend(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix of a and b, of which h bytes are known."""
    while h < WIDTH:
        x, y = a[h : h + 8], b[h : h + 8]
        if x != y:
            z = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return h + (8 * len(x) - z.bit_length()) // 8
        h += 8
    return WIDTH


def merge(runs: list[Run]) -> Iterator[tuple[int, Run]]:
    """All suffixes in order, as (common prefix with the one before, run that stands at it).

    A loser tree: a node keeps the loser of its game and its common prefix with the winner.
    Contenders know their common prefix with the last suffix put out, which is at most either of
    them, so the longer prefix wins unseen; on a tie only the bytes behind it are compared.
    """
    size = 1
    while size < len(runs):
        size *= 2
    loser: list[int] = [-1] * size
    known: list[int] = [0] * size

    def start(node: int) -> int:
        if node >= size:
            i = node - size
            return i if i < len(runs) and runs[i].step() >= 0 else -1
        i, j = start(2 * node), start(2 * node + 1)
        if i < 0 or j < 0:
            return i if j < 0 else j
        a, b = runs[i].suffix, runs[j].suffix
        known[node] = extend(a, b, 0)
        loser[node] = j if a <= b else i
        return i if a <= b else j

    i, h = start(1), 0
    while i >= 0:
        leaf = i
        yield h, runs[i]
        h = runs[i].step()
        if h < 0:
            i = -1
        node = (size + leaf) >> 1
        while node:
            j = loser[node]
            if j >= 0:
                g = known[node]
                if i < 0:
                    i, h, loser[node] = j, g, -1
                elif h < g:
                    i, loser[node] = j, i
                    h, known[node] = g, h
                elif h == g:
                    a, b = runs[i].suffix, runs[j].suffix
                    known[node] = lcp = extend(a, b, h)
                    if lcp < WIDTH and a[lcp] > b[lcp]:
                        i, loser[node] = j, i
            node >>= 1


class Answers:
    """Collects what blocks need to know of one range, group by group."""

    def __init__(self, hot: int) -> None:
        self.hot = hot
        self.replies: list[tuple[int, int, int, int]] = []
        self.windows: list[tuple[bytes, int, int, int, int]] = []
        self.classes: list[list] = []
        self.spilling = False

    def add(self, h: int, run: Run) -> None:
        doc, number = run.docs[run.at], run.base + run.at
        if h == WIDTH:
            last = self.classes[-1]
            last[2] = min(last[2], doc)
            last[3].append((run.block, number, doc))
            return
        if h < GRAM:
            self.flush(False)
            self.spilling = False
            h = 0
        elif len(self.classes) > self.hot:
            self.flush(True, h)
        self.classes.append([run.suffix, h, doc, [(run.block, number, doc)]])

    def flush(self, more: bool, following: int = 0) -> None:
        """Answers the classes at hand; with more, their group goes on, next with this common prefix."""
        classes, self.classes = self.classes, []
        self.spilling |= more
        if not classes or (len(classes) == 1 and len(classes[0][3]) == 1 and not self.spilling):
            return
        shared: list[tuple[int, int, int, list]] = []
        best: dict[bytes, int] = {}
        for k, (suffix, before, least, _) in enumerate(classes):
            after = classes[k + 1][1] if k + 1 < len(classes) else following
            right, left = suffix.find(PAD, 0, LENGTH), suffix.find(PAD, LENGTH)
            right = LENGTH if right < 0 else right
            left = LEFT if left < 0 else left - LENGTH
            low = LENGTH - right
            # a window with j bytes before the anchor can be shared only if 50 - j after it are
            both = min(max(low, LENGTH - min(LENGTH, max(before, after))), left + 1)
            back = suffix[:LENGTH - 1 : -1]
            keys = [back[LEFT - j :] + suffix[: LENGTH - j] for j in range(both, left + 1)]
            shared.append((low, both, left, keys))
            if not self.spilling:
                for w in keys:
                    if best.get(w, NULL_ID) >= least:
                        best[w] = least
        for (_, _, least, entries), (low, both, left, keys) in zip(classes, shared):
            if low > left:
                continue
            for block, number, doc in entries:
                if self.spilling:
                    covered = [doc > least] * (both - low) + [False] * len(keys)
                    self.windows += [(hashlib.blake2b(w, digest_size=16).digest(), doc, block, number, j) for j, w in enumerate(keys, both)]
                else:
                    covered = [doc > least] * (both - low) + [best[w] < doc for w in keys]
                at = 0
                while at < len(covered):
                    if not covered[at]:
                        at += 1
                        continue
                    first = at
                    while at < len(covered) and covered[at]:
                        at += 1
                    self.replies.append((block, number, -(low + at - 1), LENGTH - (low + first)))


ANSWER = "block long, number int, a int, b int, digest binary, doc long, j int"


def merge_range(blocks: list[int], payloads: list[bytes], hot: int) -> Answers:
    out = Answers(hot)
    for h, run in merge([Run(b, p) for b, p in sorted(zip(blocks, payloads))]):
        out.add(h, run)
    out.flush(False)
    return out


# --- 4: applying -----------------------------------------------------------------------------


def removed_spans(a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the union of [a, b), none across documents: (document, from, to)."""
    if not len(a):
        return (np.array([], np.int64),) * 3
    order = np.argsort(a, kind="stable")
    a, b = a[order].astype(np.int64), b[order].astype(np.int64)
    of = np.searchsorted(starts, a, side="right") - 1
    a, b = a + of, b + of  # a gap of one between documents
    reach = np.maximum.accumulate(b)
    first = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]])
    last = np.r_[first[1:], len(a)] - 1
    of = of[first]
    return of, a[first] - of, reach[last] - of


def apply_block(text: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, int, list, bytes]]:
    """(bytes, removed, runs, spans, kept bytes) of each document of a block."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    # an empty document starts where the next does: spans belong to the last that starts there
    of, x, y = removed_spans(a, b, starts)
    edges = np.searchsorted(of, np.arange(len(lengths) + 1))
    raw = memoryview(np.ascontiguousarray(text)).cast("B") if len(text) else memoryview(b"")
    for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        spans = list(zip(x[edges[k] : edges[k + 1]].tolist(), y[edges[k] : edges[k + 1]].tolist()))
        if spans:
            cuts = [s, *[p for span in spans for p in span], e]
            kept = b"".join(raw[p:q] for p, q in zip(cuts[::2], cuts[1::2]))
        else:
            kept = bytes(raw[s:e])
        yield e - s, e - s - len(kept), len(spans), [(p - s, q - s) for p, q in spans], kept


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


SORTED = "range int, block long, payload binary, h1 long, h2 long, doc long, number int"


def dedup(docs: DataFrame, ranges: int | None = None, block_bytes: int = BLOCK_BYTES, hot: int = HOT_CLASSES, hot_anchors: int = HOT_ANCHORS, texts: bool = False) -> DataFrame:
    """One row per document with what is removed; with texts also ``spans`` (byte offsets) and ``kept`` (binary).

    docs should come from files: a recomputed partition must hold the same rows in the same order.
    """
    spark = docs.sparkSession
    base = scratch(spark, "suffixes")
    parts = ranges or max(4, RANGES_PER_PART * docs.rdd.getNumPartitions())
    laid = _lay_blocks(docs, base, parts, block_bytes)
    shared = laid.groupBy("range").applyInArrow(lambda t: _shared_hashes(t, hot_anchors), "block long, payload binary, often binary")

    def sort_block(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        found, often = ([unpack_sorted(x) for x in table.column(c).to_pylist()] for c in ("payload", "often"))
        mine = _load(f"{base}/text", str(block))
        runs, windows, memory = make_runs(mine["text"], mine["lengths"], mine["ids"], np.sort(np.concatenate(found)), np.sort(np.concatenate(often)), parts)
        _save(f"{base}/memory", str(block), **memory)
        rows = [(-1, None)] + [(r, x) for r, x in enumerate(runs) if x]
        n, w = len(rows), len(windows["h1"])
        none = lambda k: pa.nulls(n, k)
        own = lambda c, k: pa.concat_arrays([none(k), pa.array(windows[c], k)])
        return pa.table(
            {
                "range": pa.array([r for r, _ in rows] + [-2] * w, pa.int32()),
                "block": pa.array([block] * (n + w), pa.int64()),
                "payload": pa.concat_arrays([pa.array([x for _, x in rows], pa.binary()), pa.nulls(w, pa.binary())]),
                "h1": own("h1", pa.int64()),
                "h2": own("h2", pa.int64()),
                "doc": own("doc", pa.int64()),
                "number": own("number", pa.int32()),
            }
        )

    runs = materialize(shared.groupBy("block").applyInArrow(sort_block, SORTED), "runs")

    def merge_table(table: pa.Table) -> pa.Table:
        got = merge_range(table.column("block").to_pylist(), table.column("payload").to_pylist(), hot)
        r, w = got.replies, got.windows
        columns = [
            [x[0] for x in r] + [x[2] for x in w],
            [x[1] for x in r] + [x[3] for x in w],
            [x[2] for x in r] + [None] * len(w),
            [x[3] for x in r] + [None] * len(w),
            [None] * len(r) + [x[0] for x in w],
            [None] * len(r) + [x[1] for x in w],
            [None] * len(r) + [x[4] for x in w],
        ]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in ANSWER.split(", ")])

    answers = materialize(runs.where("range >= 0").select("range", "block", "payload").groupBy("range").applyInArrow(merge_table, ANSWER), "answers")
    replies = answers.where("digest is null").select("block", "number", "a", "b")
    windows = answers.where("digest is not null").select("block", "number", "digest", "doc", "j")
    if not windows.isEmpty():
        least = windows.groupBy("digest").agg(F.min("doc").alias("least"))
        late = windows.join(least, "digest").where("least < doc").select("block", "number", (-F.col("j")).cast("int").alias("a"), (LENGTH - F.col("j")).cast("int").alias("b"))
        replies = replies.unionByName(late)
    # one row a block and window: a window's rows are as many as blocks that have it
    around = runs.where("range = -2").select("h1", "h2", "doc", "block", "number")
    least = around.groupBy("h1", "h2").agg(F.min("doc").alias("least"))
    late = around.join(least, ["h1", "h2"]).where("least < doc")
    replies = replies.unionByName(late.select("block", (-2 - F.col("number")).cast("int").alias("number"), F.lit(0).alias("a"), F.lit(0).alias("b")))
    every = runs.where("range = -1").select("block", F.lit(-1).alias("number"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    schema = RESULT + (", spans array<struct<`from`:long,`to`:long>>, kept binary" if texts else "")

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        block = str(key[0].as_py())
        mine, memory = _load(f"{base}/text", block), _load(f"{base}/memory", block)
        number, a, b = (np.array(table.column(c), np.int64) for c in ("number", "a", "b"))
        seen = np.zeros(len(memory["wnumber"]), bool)
        asked = np.sort(-2 - number[number <= -2])
        seen[_member(memory["wnumber"], asked)] = True
        windows = memory["wplace"][seen].astype(np.int64)
        low, high = np.searchsorted(memory["number"], number, "left"), np.searchsorted(memory["number"], number, "right")
        times = np.where(number >= 0, high - low, 0)
        at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        place = memory["place"][at].astype(np.int64)
        a, b = np.r_[memory["a"], windows, place + np.repeat(a, times)], np.r_[memory["b"], windows + LENGTH, place + np.repeat(b, times)]
        rows: list[tuple] = []
        for doc, (n, gone, count, spans, kept) in zip(mine["ids"].tolist(), apply_block(mine["text"], mine["lengths"], a, b)):
            row = (None if doc == NULL_ID else doc, n, gone, count, hashlib.sha256(kept).hexdigest())
            rows.append((*row, [{"from": p, "to": q} for p, q in spans], kept) if texts else row)
        kinds = [pa.int64()] * 4 + [pa.string()]
        names = [x.split()[0] for x in RESULT.split(", ")]
        if texts:
            kinds += [pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.binary()]
            names += ["spans", "kept"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return replies.unionByName(every).groupBy("block").applyInArrow(finish, schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
