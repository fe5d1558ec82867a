import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from timberline.llm import packing, stages, token_counts
from timberline.llm.tokens import WordEncoder, default_tokenizer

TEXTS = [
    "Hello, world. It's  a\ttest\n\nof 1234 words; don't: stop.",
    "",
    None,
    "é́ naïve space wide ΑΣ ΣΑΣ. İstanbul",
    "x" * 5000 + " " + "word, " * 3000,
    "the the the.",
    "the the the.",
    "日本語 テキスト。́ á",
    "<|endoftext|> a<|endoftext|>b",
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def test_memo_gives_the_ids_of_whole_texts(plain):
    encode = WordEncoder(default_tokenizer()).ids
    for _ in range(2):
        found = encode([(t or "").encode() for t in TEXTS])
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == [plain(t) for t in TEXTS]


def test_histogram_answers_every_limit(spark, make_docs, plain):
    docs = make_docs([(i, t) for i, t in enumerate(TEXTS)])
    hist = token_counts.length_histogram(token_counts.encoded_lengths(docs, default_tokenizer())).cache()
    lengths = sorted(len(plain(t)) for t in TEXTS)
    rows = {r.n_tokens: r for r in hist.collect()}
    assert {k: r.n_docs for k, r in rows.items()} == Counter(lengths)
    for k, r in rows.items():
        assert r.docs_at_least == sum(x >= k for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= k)
        assert r.truncated_tokens == sum(min(x, k) for x in lengths)
        assert r.cdf == pytest.approx(sum(x <= k for x in lengths) / len(lengths))
    for limit in (0, 1, 7, 100, 10**6):
        r = token_counts.totals_at(hist, limit).first()
        assert (r.docs_over, r.tokens, r.tokens_kept) == (sum(x > limit for x in lengths), sum(lengths), sum(min(x, limit) for x in lengths))
    assert token_counts.quantile(hist, 0.5).first()[0] == lengths[len(lengths) // 2]


def test_histogram_of_nothing(spark, make_docs):
    assert token_counts.length_histogram(token_counts.encoded_lengths(make_docs([(0, "")]).limit(0), default_tokenizer())).count() == 0


def test_packing_is_a_partition_of_all_ids(make_docs, plain):
    rows = [(i, t) for i, t in enumerate(TEXTS * 9)] + [(None, "null id"), (3, "repeated id"), (3, "repeated id")]
    out = packing.pack_documents(make_docs(rows)).collect()
    ids = {(d, len(plain(t)) + 1, zlib.crc32(np.array([*plain(t), 1], "<u4").tobytes())) for d, t in rows}
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.length > 0
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(by_doc) == {d for d, _ in rows}
    assert sum(r.length for r in out) == sum(len(plain(t)) + 1 for _, t in rows)
    for d, t in rows[: len(TEXTS) * 9]:
        if d == 3:
            continue
        whole = np.array([*plain(t), 1], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(whole))
            assert r.ids_crc32 == zlib.crc32(whole[at : at + r.length].tobytes())
            at += r.length
        assert at == len(whole)
    assert ids
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY


def test_differencing_is_near_equal_and_the_count_rises():
    sizes = [(i * 37) % 256 + 1 for i in range(400)]
    windows = packing.differencing(sizes, 16)
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(400))
    assert max(sums) - min(sums) <= 2
    assert len(packing.spread([1025] * 4)) == 4
    assert packing.spread([]) == []
    assert packing.spread([5]) == [[0]]


def test_packing_stage_leaves_no_memo_in_its_workers(spark, make_docs, tmp_path):
    docs = make_docs([(i, f"alpha{i} beta gamma{i}") for i in range(40)])
    # twice: what other tests left in these workers goes, too
    for _ in range(2):
        assert stages.pack_sequences(spark, docs.repartition(8), str(tmp_path)).count() == 40

    def held(batches):
        import gc

        from timberline.llm import tokens

        for _ in batches:
            yield pa.record_batch([pa.array([sum(len(e.memo) for e in tokens._ENCODERS.values())]), pa.array([gc.isenabled()])], ["words", "collects"])

    # the same workers are used again
    rows = spark.range(0, 16, 1, 4).mapInArrow(held, "words long, collects boolean").collect()
    assert rows and all(r.words == 0 and r.collects for r in rows)
