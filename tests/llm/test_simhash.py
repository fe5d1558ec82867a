import random
import re

import numpy as np
import xxhash

from timberline.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_fingerprint():
    rng = random.Random(5)
    texts = ["", "  \n", "one", "One two THREE", "a b c d", "a b c d e", "Äpfel É x y z Ä", " ".join(rng.choice("abcd") for _ in range(300)), "\x0b a\x0cb\x1cc"]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == brute_fingerprint(t)


def families(seed, n):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            out.append(base)
            for _ in range(rng.randrange(0, 7)):
                base ^= 1 << rng.randrange(64)
    return out[:n]


def test_chains_lose_no_link(spark):
    fps = sorted(set(families(1, 350)))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    want = brute_components(fps)
    for hot in (50_000, 1):  # 1: every shared key goes on to the longer chain
        links = [(r.u, r.v) for r in simhash.near_links(nodes, hot).collect()]
        at = {x: i for i, x in enumerate(signed)}
        root = list(range(len(fps)))
        for u, v in links:
            assert (fps[at[u]] ^ fps[at[v]]).bit_count() <= 4
            a, b = root[at[u]], root[at[v]]
            root = [min(a, b) if r in (a, b) else r for r in root]
        assert root == want


def test_documents(spark, make_docs):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(120)]
        rows.append((len(rows), " ".join(text)))
        for _ in range(i % 4):
            text[rng.randrange(120)] = "edit"
            rows.append((len(rows), " ".join(text).upper() if i % 2 else " ".join(text)))
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "a"), (1003, "a"), (1004, "one two")]
    rng.shuffle(rows)
    out = simhash.near_duplicates(make_docs(rows)).collect()
    fps = {d: brute_fingerprint(t) for d, t in rows}
    order = sorted(fps)
    want = dict(zip(order, (order[r] for r in brute_components([fps[d] for d in order]))))
    assert len(out) == len(rows)
    for r in out:
        assert r.fp & (2**64 - 1) == fps[r.doc_id]
        assert r.component_id == want[r.doc_id]


def test_empty(spark, make_docs):
    assert simhash.near_duplicates(make_docs([(1, "a")]).limit(0)).count() == 0
