import hashlib
import random
import re
import time

import xxhash

from timberline.llm import fingerprints as fp

MASK = (1 << 64) - 1


def pieces(text):
    """The cells by their definition, character by character."""
    cut, blank = set("abcdefghABCDEFGH01234.,;:!?"), " \t\r\n"
    out = []
    for zone, least, most in ((text[:16], None, 2), (text[16:256], 4, 40), (text[256:], 48, 180)):
        at = 0
        while at < len(zone):
            end = min(len(zone), at + most)
            if least is not None:
                for n in range(least, most + 1):
                    if at + n + 1 < len(zone) and zone[at + n] in cut and zone[at + n + 1] in blank:
                        end = at + n + 1
                        while end < len(zone) and zone[end] in blank:
                            end += 1
                        break
            out.append(zone[at:end][:255])
            at = end
    return out


def digests(text):
    return {(xxhash.xxh64_intdigest(r.encode(), 42) & ~255 & MASK) | len(r) for r in pieces(text)}


def table(ds):
    """The 12 cells of a digest set, cell by cell."""
    cells = [[0, 0, 0] for _ in range(12)]
    for d in ds:
        check = xxhash.xxh64_intdigest(d.to_bytes(8, "little"), 42)
        for block in range(3):
            cell = cells[4 * block + (d >> (8 + 2 * block) & 3)]
            cell[0] += 1
            cell[1] ^= d
            cell[2] ^= check
    return "".join(f"{n:08x}{k:016x}{c:016x}" for n, k, c in cells)


def weight(ds):
    return sum(d & 255 for d in ds)


def likeness(a, b):
    x, y = digests(a), digests(b)
    total = weight(x) + weight(y)
    return 1.0 if not total else 1 - weight(x ^ y) / total


def corpus():
    rng = random.Random(3)
    words = [f"wörd{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "\n", "."]) for _ in range(n))
    rows = [(i * 2, text(rng.choice([0, 1, 3, 10, 60, 400, 1500]))) for i in range(60)]
    rows += [(201, rows[5][1]), (203, rows[9][1]), (205, None), (207, ""), (209, "a"), (211, "日本語テキスト" * 30), (213, "\n\n"), (-5, "first")]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(make_docs):
    rows = corpus()
    ordered = sorted(rows)
    for buckets in (None, 1, 7, 200):
        found = {r.doc_id: r for r in fp.versions(make_docs(rows), buckets).collect()}
        assert len(found) == len(rows)
        for i, (d, t) in enumerate(ordered):
            t, after = t or "", ordered[(i + 1) % len(ordered)][1] or ""
            q = len(t) // 4
            edited = t[: len(t) - q] + after[:q]
            r = found[d]
            assert r.n_chars == len(t)
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert r.fingerprint == table(digests(t))
            assert r.edited_fingerprint == table(digests(edited))
            assert abs(r.near_edited - likeness(t, edited)) < 1e-9
            assert abs(r.near_next - likeness(t, after)) < 1e-9


def test_small_tables_do_peel(spark, make_docs):
    """Few differences are recovered from the 12 cells, more from the 96, without looking at the digests."""
    base = " ".join(f"term{i}" for i in range(900))
    for edits, cells in ((1, 12), (12, 96)):
        other = base
        for k in range(edits):
            other = other[: 300 + 256 * k] + "#" + other[301 + 256 * k :]
        df = make_docs([(1, base)]).withColumn("other", fp.F.lit(other))
        df = df.withColumn("da", fp.digests("text")).withColumn("db", fp.digests("other"))
        df = df.withColumn("la", fp.subtables("da")).withColumn("lb", fp.subtables("db")).withColumn("sa", fp.folded("la")).withColumn("sb", fp.folded("lb"))
        small = fp.peeled(fp.difference("sa", "sb"))
        large = f"aggregate(zip_with(la, lb, (t, u) -> {fp.difference('t', 'u')}), 0L, (a, t) -> if(a IS NULL, a, a + {fp.peeled('t')}))"
        r = df.select(fp.F.expr(small).alias("s"), fp.F.expr(large).alias("l")).first()
        want = weight(digests(base) ^ digests(other))
        assert r.l == want
        assert r.s == (want if cells == 12 else None)


def test_every_rung_gives_the_same(make_docs):
    rng = random.Random(6)
    base = [rng.choice("abcdefghij") for _ in range(9000)]
    rows = [(0, "".join(base))]
    for k in range(1, 30):
        for _ in range(k):
            base[rng.randrange(len(base))] = "#"
        rows.append((k, "".join(base)))
    got = {r.doc_id: r.near_next for r in fp.versions(make_docs(rows)).collect()}
    for i in range(30):
        assert abs(got[i] - likeness(rows[i][1], rows[(i + 1) % 30][1])) < 1e-9


def test_ties_and_single(make_docs):
    r = fp.versions(make_docs([(1, "abcdefgh")])).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    out = fp.versions(make_docs([(1, "x"), (1, "x"), (None, "n"), (1, "y")])).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in out) == [(0, 1), (1, 1), (1, 1), (1, 1)]
    assert fp.versions(make_docs([(1, "a")]).limit(0)).count() == 0


def test_an_insertion_leaves_most_cells(make_docs):
    rng = random.Random(8)
    words = [f"wort{i}{c}" for i in range(200) for c in "aeknt"]
    text = " ".join(rng.choice(words) for _ in range(700))
    for put in ("x", "some more words here "):
        rows = [(1, text), (2, text[:5] + put + text[5:]), (3, " ".join(rng.choice(words) for _ in range(700)))]
        got = {r.doc_id: r.near_next for r in fp.versions(make_docs(rows)).collect()}
        assert got[1] > 0.85 > 0.2 > got[2]


def test_each_size_of_tables(spark):
    """Sets that differ in few to very many digests, from the digests and from tables alone."""
    rng = random.Random(9)
    sets = []
    for n in (0, 1, 5, 40, 300, 3000, 9000):
        a = [rng.getrandbits(63) for _ in range(n)]
        sets.append((a, a[n // 2 :] + [rng.getrandbits(63) for _ in range(n)]))
    df = spark.createDataFrame(sets, "da array<bigint>, db array<bigint>")
    df = df.withColumn("la", fp.subtables("da")).withColumn("lb", fp.subtables("db")).withColumn("sa", fp.folded("la")).withColumn("sb", fp.folded("lb"))
    got = df.select(fp.F.expr(fp.differing("sa", "sb", "la", "lb", "da", "db")).alias("w"), fp.F.size("da").alias("n")).collect()
    assert {r.n: r.w for r in got} == {len(a): weight(set(a) ^ set(b)) for a, b in sets}


def test_cutting_takes_no_longer_than_a_plain_pass(spark):
    """A few nanoseconds a character: as a pattern of [\\s\\S] it took over 400."""
    text = fp.F.concat(fp.F.repeat(fp.F.lit("some words of a text that goes on "), fp.F.lit(3000)), fp.F.col("id").cast("string"))
    df = spark.range(80).repartition(1).select(text.alias("text"))
    took = []
    for _ in range(3):
        began = time.monotonic()
        assert df.agg(fp.F.sum(fp.F.size(fp.digests("text")))).first()[0] > 0
        took.append(time.monotonic() - began)
    assert min(took) / (80 * 102_000) < 200e-9


def test_a_block_names_its_digests(spark):
    """A block whose cells hold one digest at most says all at once; peeling gives the same, and hopeless tables none."""
    rng = random.Random(12)
    df = spark.createDataFrame([([rng.getrandbits(63) for _ in range(n)], [rng.getrandbits(63) for _ in range(m)]) for n in (0, 1, 2, 3, 40) for m in (0, 1, 2)], "da array<bigint>, db array<bigint>")
    both = "concat(da, db)"
    got = df.select("da", "db", *[fp.F.expr(fp.named(fp._block(both, at))).alias(f"b{at}") for at in (0, 4, 8)], fp.F.expr(fp.peeled(fp._both("da", "db"))).alias("p"), fp.F.expr(fp.decided(fp._both("da", "db"))).alias("d")).collect()
    for r in got:
        want = weight({*r.da, *r.db})
        for at in range(3):
            cells = [d >> 8 + 2 * at & 3 for d in (*r.da, *r.db)]
            assert r[f"b{4 * at}"] == (want if len(set(cells)) == len(cells) else None)
        assert r.p == r.d == (None if len(r.da) == 40 else want)
