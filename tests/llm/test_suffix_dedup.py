import hashlib
import random

import numpy as np
import pytest

from timberline.llm import suffix_dedup as sd


def brute(rows):
    """doc_id to what is left, by a table of all 50-byte strings."""
    least = {}
    data = [(sd.NULL_ID if d is None else d, (t or "").encode()) for d, t in rows]
    for d, t in data:
        for i in range(len(t) - 49):
            w = t[i : i + 50]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, t in data:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 49):
            if least[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((None if d == sd.NULL_ID else d, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "délta", "x", "yy", "Zeta,", "eta.", "日本"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))
    rows = [(i * 3, text(rng.randrange(0, 80))) for i in range(40)]
    phrase = text(9)[:60]
    for i in range(60):
        kind = i % 6
        base = rng.choice(rows)[1] or ""
        if kind == 0:
            t = base
        elif kind == 1:
            t = text(5) + base[: len(base) // 2] + text(4)
        elif kind == 2:
            t = text(3) + phrase[: rng.randrange(20, 60)] + text(3)
        elif kind == 3:
            t = base[rng.randrange(30) :] + base[:70]
        elif kind == 4:
            t = "ab" * rng.randrange(10, 200)
        else:
            t = phrase[rng.randrange(8) :] + phrase + text(2)
        rows.append((rng.randrange(400) * 3 + 1, t))
    rows += [(None, rows[0][1]), (5000, ""), (5001, None), (5002, "short"), (5003, "z" * 300), (5004, "z" * 49), (5005, "z" * 50), (7, rows[3][1]), (7, rows[3][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, block, hot, often", [(1, 3000, 20_000, 20_000), (2, 3000, 1, 20_000), (3, 10**7, 2, 5), (4, 500, 20_000, 3), (5, 2000, 20_000, 1), (6, 2000, 20_000, 20)])
def test_against_brute_force(make_docs, seed, block, hot, often):
    rows = corpus(seed)
    found = sd.dedup(make_docs(rows), ranges=3, block_bytes=block, hot=hot, hot_anchors=often, texts=True).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=str) == brute(rows)
    for r in found:
        assert sum(s["to"] - s["from"] for s in r.spans) == r.n_removed
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_empty(make_docs):
    assert sd.dedup(make_docs([(1, "a")]).limit(0)).count() == 0


def test_merge_orders_and_knows_prefixes():
    rng = random.Random(9)
    runs, every = [], []
    for block in range(7):
        rows = sorted({bytes(rng.choice(b"ab") for _ in range(sd.WIDTH)) if rng.random() < 0.3 else b"a" * rng.randrange(sd.WIDTH) for _ in range(rng.randrange(0, 60))})
        rows = [r.ljust(sd.WIDTH, b"c") for r in rows]
        rows = sorted(set(rows))
        if not rows:
            continue
        lcps = [0] + [sd.extend(a, b, 0) for a, b in zip(rows, rows[1:])]
        raw = np.array([len(rows), 0], "<i8").tobytes() + np.arange(len(rows), dtype="<i8").tobytes() + bytes(lcps) + b"".join(r[k:] for r, k in zip(rows, lcps))
        import pyarrow as pa

        runs.append(sd.Run(block, np.array([len(raw)], "<i8").tobytes() + pa.Codec("zstd").compress(raw).to_pybytes()))
        every += rows
    out = [(h, r.suffix) for h, r in sd.merge(runs)]
    assert [x for _, x in out] == sorted(every)
    assert [h for h, _ in out][1:] == [sd.extend(a, b, 0) for (_, a), (_, b) in zip(out, out[1:])]


def test_hashes_round_trip():
    for v in ([], [0], [5, 6, 7], [0, 1 << 39], list(range(0, 1 << 40, 1 << 36))):
        assert sd.unpack_sorted(sd.pack_sorted(np.array(v, np.int64))).tolist() == v
