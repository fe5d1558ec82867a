import random

import pytest

from timberline.llm import mixing


def test_targets_reshare_the_excess():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 1000], [5, 2]) == pytest.approx([30, 980])
    assert mixing.targets([], []) == []
    assert mixing.targets([0, 0], [5, 2]) == [0, 0]
    rng = random.Random(1)
    sizes = [rng.randrange(1, 10**6) for _ in range(40)]
    got = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(40)])
    assert sum(got) == pytest.approx(sum(sizes))
    assert all(t <= 3 * s * (1 + 1e-12) for t, s in zip(got, sizes))


def test_flight_keeps_both_totals():
    rng = random.Random(3)
    sizes = [rng.randrange(1, 500) for _ in range(800)]
    p = [0.37] * 800
    mixing.flight(sizes, p, random.Random(1))
    assert sum(0 < x < 1 for x in p) <= 2
    assert sum(p) == pytest.approx(0.37 * 800, abs=1e-5)
    assert sum(x * s for x, s in zip(p, sizes)) == pytest.approx(0.37 * sum(sizes), rel=1e-6)
    same = [0.5] * 10
    mixing.flight([7] * 10, same, random.Random(1))
    assert sum(same) == pytest.approx(5)


@pytest.mark.parametrize("chunk", [20_000, 16])
def test_mix(spark, make_docs, chunk):
    rng = random.Random(4)
    sources = ["a", "b", "Z", "é", None]
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 60))), sources[min(4, int(rng.expovariate(0.7)))]) for i in range(600)]
    rows += [(700, None, "a"), (701, "x y", "a"), (701, "x y", "a")]
    out = mixing.mix(make_docs(rows), chunk=chunk).collect()
    again = mixing.mix(make_docs(list(reversed(rows))), chunk=chunk).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert len(out) == len(rows)
    sizes = {s: sum(len((t or "").split()) for _, t, u in rows if u == s) for s in sources}
    order = sorted((s for s in sources if s), key=lambda s: s.encode()) + [None]
    want = dict(zip(order, mixing.targets([sizes[s] for s in order], [5, 2, 1, 5, 2])))
    for s in sources:
        own = [r for r in out if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 60
        if sum(r.size > 0 for r in own):
            expected = want[s] / sizes[s] * sum(r.size > 0 for r in own)
            assert abs(sum(r.copies for r in own) - expected) <= 3
    assert all(r.taken == r.copies * r.size and r.taken <= 3 * r.size for r in out)


def test_empty(make_docs):
    assert mixing.mix(make_docs([(1, "a")]).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(make_docs([(1, ""), (2, None)])).collect()] == [0, 0]
