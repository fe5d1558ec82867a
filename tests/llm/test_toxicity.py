import random
import zlib

import pytest
from pyspark.sql import functions as F

from timberline.llm import toxicity as tox

CLEAN = [f"word{i}" for i in range(400)]
MARKS = ["grubnik", "folzet", "snarkled", "idiot"]


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randrange(5, 120))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randrange(1, 4)):
                mark = rng.choice(MARKS)
                words.insert(rng.randrange(len(words)), mark if rng.random() < 0.5 else mark.upper() + ".")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark, make_docs):
    rows, labels = corpus()
    rows += [(9000, None), (9001, ""), (9002, "x" * 200_000), (5, rows[5][1]), (None, "null id")]
    docs, table = make_docs(rows), spark.createDataFrame(labels + [(7000, 1, None)], "doc_id long, quality int, toxic int")
    grammar = tox.fit(docs, table)
    out = tox.score(docs, grammar).withColumn("held_out", F.coalesce(tox.remainder() == 0, F.lit(False))).collect()
    assert len(out) == len(rows)
    truth = {d: t for d, _, t in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 50
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(not r.predicted for r in out if r.doc_id in (9000, 9001, 9002, None))
    kept = tox.nontoxic(docs.withColumn("row", F.lit(1)).withColumn("t", F.lit(2)), grammar)
    assert kept.columns == [*docs.columns, "row", "t"]
    bad = {r.doc_id for r in out if r.predicted}
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted((d if d is not None else -1) for d, _ in rows if d not in bad)


def test_held_out_labels_are_not_read(spark, make_docs):
    rows, labels = corpus()
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    docs = make_docs(rows)
    grammars = [tox.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped)]
    assert grammars[0] == grammars[1]


def test_without_labels(spark, make_docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    grammar = tox.fit(make_docs([(1, "you idiot, you stupid moron")]), empty)
    got = {r.doc_id: r.score for r in tox.score(make_docs([(1, "you stupid idiot, you moron scum"), (2, "a fine day")]), grammar).collect()}
    assert got[1] > 0.5 > got[2]
    assert tox.score(make_docs([(1, "a")]).limit(0), grammar).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("you are an idiot.", [(0, 1, 0, 0)]),
        ("idiot, you.", [(0, 1, 0, 0)]),
        ("he is not an idiot.", [(0, 1, 1, 0)]),
        ("she said: fine. he said idiot.", [(0, 1, 0, 1)]),
        ("plain idiot", [(0, 0, 0, 0)]),
        ("not one two three four idiot", [(0, 0, 0, 0)]),
        ("we will kill", [(2, 0, 0, 0)]),
        ("kill you. it was trash", [(1, 1, 0, 0), (0, 0, 0, 0)]),
    ],
)
def test_arcs_of_clauses(text, want):
    lexical = tox.LexicalTransducer(tox.Grammar())
    words = text.encode().split()
    assert lexical.read(words)
    assert [tox.ARCS[a] for clause in tox.matches(words, lexical) for a, _ in clause] == want


def brute_arcs(words):
    """The arcs of each clause by their definition, word by word, without machines."""
    fixed = {w: n for n, ws in (("t", tox.TARGETS), ("n", tox.NEGATORS), ("r", tox.REPORTS), ("i", tox.INTENTS), ("x", tox.INSULTS), ("k", tox.THREATS)) for w in ws.split()}
    clause, out = [], []
    for w in [*words, None]:
        if w is not None:
            clause.append(w)
        if w is None or w.endswith("."):
            kinds = [fixed.get(c.strip("."), "") for c in clause]
            found = []
            for i, k in enumerate(kinds):
                if k in ("x", "k"):
                    kind = 0 if k == "x" else 2 if "i" in kinds[:i] else 1
                    found.append((kind, int("t" in kinds), int("n" in kinds[max(0, i - 3) : i]), int("r" in kinds[:i])))
            out.append(found)
            clause = []
    return out


def test_composition_against_brute_force():
    rng, lexical = random.Random(6), tox.LexicalTransducer(tox.Grammar())
    names = ["word", "tree", "you", "not", "said", "will", "idiot", "kill", "scum"]
    for _ in range(400):
        words = [rng.choice(names) + ("." if rng.random() < 0.15 else "") for _ in range(rng.randrange(1, 30))]
        lexical.read(raw := [w.encode() for w in words])
        got = [[tox.ARCS[a] for a, _ in clause] for clause in tox.matches(raw, lexical)]
        assert [c for c in got if c] == [c for c in brute_arcs(words) if c]
    assert 1 < len(lexical.machine.following) <= 2 * 2 * 4 * 2


def test_a_stronger_clause_never_lowers_a_score():
    rng = random.Random(7)
    x = [(rng.random() * 3 * y, rng.random() * 2, rng.random() * y) for y in (rng.random() < 0.3 for _ in range(300))]
    w = tox.not_negative(tox.np.array(x), tox.np.array([float(r[0] > 0) for r in x]))
    assert all(v >= 0 for v in w[1:]) and w[1] > 0
    arcs = tox.learned_arcs({(3, 1): 40, (3, 0): 1, (0, 1): 2, (0, 0): 60}, 100, 1000)
    assert all(v >= 0 for v in arcs) and arcs[0] < tox.prior_arcs()[0] and arcs[1] == tox.prior_arcs()[1]


def test_rows_are_sent_with_their_text_once(spark, make_docs):
    rows = [(1, "you stupid idiot, you moron scum"), (2, "a fine day"), (3, None), (4, "")]
    docs = make_docs(rows).withColumnRenamed("text", "Text")
    kept = tox.nontoxic(docs, tox.Grammar())
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert "as binary" not in kept._jdf.queryExecution().optimizedPlan().toString()
    raw = docs.withColumn("Text", F.col("Text").cast("binary"))
    assert sorted(r.doc_id for r in tox.nontoxic(raw, tox.Grammar()).collect()) == [2, 3, 4]
