import random
import re

import numpy as np

from timberline.llm import near_dedup, simhash, stages
from timberline.llm.components import components


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute_groups(texts):
    sets, root = [brute_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def corpus():
    """Families of texts around the similarity, with a passage that all long ones quote."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    quote, texts = [rng.choice(words) for _ in range(30)], []
    for i in range(50):
        text = [rng.choice(words) for _ in range(rng.choice([3, 5, 6, 20, 100, 300]))]
        text += quote if len(text) > 50 else []
        for _ in range(rng.randrange(1, 6)):
            texts.append(" ".join(text).upper() if i % 2 else " ".join(text))
            for _ in range(rng.randrange(0, 1 + len(text) // 60)):
                text[rng.randrange(len(text))] = rng.choice(words)
    # 5 of n + 5 shingles differ a side: n = 40 and 39 are on both sides of 0.8
    for n in (40, 39):
        text = [f"x{n}a{i}" for i in range(n + 9)]
        texts += [" ".join(text), " ".join([*text[:20], "edit", *text[21:]])]
    return texts + [None, "", " \t", "a", "a", "one two"]


def test_every_similar_pair(spark, make_docs, monkeypatch):
    texts = corpus()
    rows = list(enumerate(texts))
    want = brute_groups(texts)
    assert len(set(want)) < len(want) - 40
    for often, flush in ((3, 1 << 20), (10**6, 4)):  # with and without the order by frequency
        monkeypatch.setattr(near_dedup, "OFTEN", often)
        monkeypatch.setattr(near_dedup, "FLUSH", flush)
        random.Random(often).shuffle(rows)
        out = near_dedup.near_duplicates(make_docs(rows)).collect()
        assert {r.doc_id: r.component_id for r in out} == dict(enumerate(want))
        assert len(out) == len(rows)


def test_cross_pairs():
    rng = np.random.default_rng(2)
    key = np.sort(rng.integers(0, 6, 90))
    label = rng.integers(0, 4, 90)
    order = np.lexsort((label, key))
    key, label, node = key[order], label[order], np.arange(90) * 7
    want = {(node[i], node[j]) for i in range(90) for j in range(i + 1, 90) if key[i] == key[j] and label[i] != label[j]}
    for flush in (1, 5, 1 << 20):
        near_dedup.FLUSH, was = flush, near_dedup.FLUSH
        got = [(a, b) for u, v in near_dedup.cross_pairs(key, label, node, np.full(90, 50 << 32)) for a, b in zip(u, v)]
        near_dedup.FLUSH = was
        assert set(got) == want and len(got) == len(want)


def test_a_row_stays_of_each_group_whatever_the_ids(spark, tmp_path):
    rows = [(None, "alpha beta gamma delta eps zeta"), (None, "one two three four five six"), (1, "ein zwei drei vier acht neun"), (1, "un deux trois quatre sept huit"), (1, "un deux trois quatre sept huit")]
    rows += [(2, None), (None, ""), (7, "Alpha beta GAMMA delta eps zeta"), (None, "one two three four five six")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, near_dedup_row long").repartition(3)
    got = stages.drop_near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(None, "one two three four five six"), (1, rows[2][1]), (1, rows[3][1]), (2, None), (7, rows[7][1])], key=str)


def test_stage_drops_what_differs_in_more_than_4_bits(spark, make_docs, tmp_path):
    text = [f"t{i}" for i in range(49)]
    rows = [(1, " ".join(text)), (2, " ".join([*text[:20], "edit", *text[21:]])), (3, " ".join(text[:39]))]
    assert sorted(r.doc_id for r in stages.drop_near_duplicates(spark, make_docs(rows), str(tmp_path)).collect()) == [1, 3]


def test_empty_and_short(spark, make_docs):
    assert near_dedup.near_duplicates(make_docs([(1, "a")]).limit(0)).count() == 0
    assert len(near_dedup.shingles(b" ")) == 0
    assert np.array_equal(near_dedup.shingles(b"A b\tc"), near_dedup.shingles(b"a  B c"))


def test_sketches_bound_the_difference():
    rng = random.Random(3)
    for _ in range(200):
        a = {rng.getrandbits(64) for _ in range(rng.choice([1, 40, 200]))}
        b = set(rng.sample(sorted(a), rng.randrange(len(a)))) | {rng.getrandbits(64) for _ in range(rng.choice([1, 30, 500]))}
        assert near_dedup.apart(*(near_dedup.sketch(np.array(sorted(x), np.uint64)) for x in (a, b))) <= len(a ^ b)
    assert near_dedup.apart(near_dedup.sketch(np.arange(40, dtype=np.uint64)), near_dedup.sketch(np.arange(90, dtype=np.uint64))) == 50


def test_simhash_goes_first(spark, make_docs, monkeypatch):
    """What pigeonring chains link is connected without prefixes; what differs in more bits is left to them."""
    rng = random.Random(6)
    text = [f"b{i}" for i in range(3000)]
    rows = [(i, " ".join(text[:k] + ["edit"] * bool(i) + text[k:])) for i, k in enumerate((0, 100, 2000, 2900))]
    rows += [(9, " ".join(rng.choice(text) for _ in range(400))), (10, None), (11, "a")]
    docs = make_docs(rows)
    brief = near_dedup.node_rows(docs).where("sketch is not null").select("node", "n", "sketch", "fp").dropDuplicates(["node"])
    fps = {r.node: r.fp & (2**64 - 1) for r in brief.collect()}
    root = {x: x for x in fps}
    for x in fps:
        for y in fps:
            if (fps[x] ^ fps[y]).bit_count() <= simhash.LIMIT:
                a, b = root[x], root[y]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    got = {r.node: r.component for r in components(near_dedup.by_bits(brief)).collect()}
    assert {x: got.get(x, x) for x in fps} == root and len(set(root.values())) == 4
    monkeypatch.setattr(near_dedup, "shared_rows", lambda rows: rows.selectExpr("key", "node", "at", "node head", "node prev").limit(0))
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert out == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9, 10: 10, 11: 11}
