import random
import re

import numpy as np

from timberline.llm import repetition

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, least):
    words = W.findall(text or "")
    n = len(words)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                longest[i] = max(longest[i], k)
    rep, cov = set(), set()
    for i, k in enumerate(longest):
        if k >= 3:
            rep.update((i, i + 1, i + 2))
        if k >= least:
            cov.update(range(i, i + k))
    return n, len(rep), len(cov), max([k for k in longest if k >= 3], default=0)


def texts():
    rng = random.Random(7)
    out = ["", None, "a", "a a a a a", "a b c a b c", "x y z\nq\nx y z", " \n\t"]
    for i in range(40):
        words = [rng.choice("abcde") if i % 3 else f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 70))]
        if i % 4 == 0:
            words += words[:20] + ["mid"] + words[5:25]
        out.append(" ".join(words))
    return out


def test_facts_against_brute_force():
    for least in (3, 5, 8):
        found = repetition.text_facts([(t or "").encode() for t in texts()], least)
        for k, t in enumerate(texts()):
            assert tuple(int(c[k]) for c in found) == brute(t, least), t


def test_query_columns(make_docs):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows.append((900, "#a $b\nline one\nline one\n \n \nline  one\n" + " ".join(f"u{i}" for i in range(60))))
    rows.append((901, " ".join(f"é{i}" for i in range(80))))
    rows.append((902, " ".join(f"u{i}" for i in range(60)) + " " + " ".join(f"u{i}" for i in range(60))))
    for r in repetition.judge(make_docs(rows)).collect():
        text = dict(rows)[r.doc_id] or ""
        words, lines = W.findall(text), [x for x in text.split("\n") if W.search(x)]
        n, rep, _, _ = brute(text, 8)
        assert (r.n_words, r.n_repeat_words) == (n, rep)
        assert r.word_chars == sum(map(len, words))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.base_failed and r.kept)
        if r.doc_id in (900, 901):
            assert r.kept
    assert repetition.judge(make_docs([(1, "a")]).limit(0)).count() == 0


def test_one_pass_for_long_texts_agrees(monkeypatch):
    rng = np.random.default_rng(5)
    cases = [rng.integers(0, k, n) for n in (2, 3, 50, 400) for k in (1, 2, 7, 1000)] + [np.tile(np.arange(9), 40)]
    want = [repetition.longest_repeats(c.astype(np.int64)) for c in cases]
    monkeypatch.setattr(repetition, "KASAI", 0)
    assert all(np.array_equal(repetition.longest_repeats(c.astype(np.int64)), w) for c, w in zip(cases, want))
