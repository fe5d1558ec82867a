import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dedup import brute_groups
from tests.llm.test_toxicity import CLEAN, corpus
from timberline.llm import line_dedup, mixing, packing, stages, toxicity
from timberline.llm.components import components
from timberline.llm.tokens import default_tokenizer


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    rows, labels = corpus(400, 3)
    rows = [(d, t + "\nShared footer line of the site" + (" x" if d % 3 else "")) for d, t in rows]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 60, 2)]
    rows += [(2000 + i, rows[i][1].replace("word1", "word1x", 1)) for i in range(0, 40, 2)]
    rows += [(3000, None), (3001, ""), (3002, "y" * 50_000)]
    full = [(d, t, "en", ["s0", "s1", None][min(2, int(rng.expovariate(1)))], len(t or "")) for d, t in rows]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    assert CLEAN
    return str(at)


def test_each_stage_against_brute_force(spark, tables, tmp_path):
    docs, names = spark.read.parquet(f"{tables}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{k}")
        before, after = docs.collect(), spark.read.parquet(f"{tmp_path}/{k}")
        names.append(name)
        if k < 4:
            assert after.columns == docs.columns
            rows = after.collect()
            assert all(r.n_chars == len(r.text or "") for r in rows) or name != "line_dedup"
        if name == "toxicity":
            grammar = toxicity.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
            lexical = toxicity.LexicalTransducer(grammar)
            keep = {r.doc_id for r in before if toxicity.logistic(grammar.logistic, toxicity.facts((r.text or "").encode().split(), lexical)) < 0.5}
            assert {r.doc_id for r in rows} == keep and 0 < len(keep) < len(before)
        elif name == "line_dedup":
            want = brute_lines([(r.doc_id, r.text, r.source) for r in before], line_dedup.RATIO, line_dedup.LEAST_PAGES)
            assert {r.doc_id: r.text for r in rows} == want
            assert not any("Shared footer" in (r.text or "") for r in rows)
        elif name == "simhash_near_dedup":
            order = sorted(before, key=lambda r: r.doc_id)
            roots = brute_groups([r.text for r in order])  # five words, a similarity of 0.8
            assert sorted(r.doc_id for r in rows) == sorted({order[i].doc_id for i in roots})
            assert len(rows) < len(before)
        elif name == "mixing":
            sizes, taken = Counter(), Counter()
            for r in before:
                sizes[r.source] += len((r.text or "").split())
            for r in rows:
                taken[r.source] += len((r.text or "").split())
            sources = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
            goal = mixing.targets([sizes[s] for s in sources], [(5, 2, 1)[i % 3] for i in range(len(sources))])
            for s, g in zip(sources, goal):
                assert abs(taken[s] - g) <= 130
            assert max(Counter(r.doc_id for r in rows).values()) <= 3
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(default_tokenizer())
            want = Counter()
            for r in before:
                ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
                for s, n in packing.cuts(len(ids)):
                    want[r.doc_id, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
            rows = after.collect()
            assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows) == want
            fill = defaultdict(int)
            for r in rows:
                fill[r.sequence_id] += r.length
            assert max(fill.values()) <= packing.CAPACITY
        docs = after
    assert len(names) == 5
    assert corpus_pipeline.run(spark, tables).count() == docs.count()


def test_pipeline_on_nothing(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(-50, 300), rng.randrange(-50, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(1, 80)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    linked = {x for u, v in links if u != v for x in (u, v)}
    assert got == {x: root(x) for x in linked}


def test_copies_are_those_of_the_mix(spark, make_docs, tmp_path):
    rows = [(i % 3 if i % 5 else None, f"w{i} a b c", ["s", None][i % 2]) for i in range(200)] + [(9, "w a b c", "t")] * 30
    docs = make_docs(rows)
    want, got = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source] += r.copies
    for r in stages.mix_sources(spark, docs, str(tmp_path)).collect():
        got[r.doc_id, r.source] += 1
    assert got == Counter({k: n for k, n in want.items() if n})
