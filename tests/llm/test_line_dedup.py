from collections import Counter, defaultdict

from pyspark.sql import functions as F

from timberline.llm import line_dedup


def brute(rows, ratio, least):
    pages, seen = Counter(), defaultdict(Counter)
    trim = lambda x: x.strip(" \t\x0b\x0c\r")
    for _, text, host in rows:
        pages[host] += 1
        for key in {trim(x) for x in (text or "").split("\n")} - {""}:
            seen[host][key] += 1
    out = {}
    for d, text, host in rows:
        gone = {k for k, n in seen[host].items() if n >= least and n > ratio * pages[host]}
        out[d] = None if text is None else "\n".join(x for x in text.split("\n") if trim(x) not in gone)
    return out


def test_against_brute_force(make_docs):
    rows = []
    for i in range(120):
        host = ["a", "b", None][i % 3]
        lines = [f"body {i}", "Menu | Home" if i % 2 else "  Menu | Home\t", "", f"part {i % 20}", f"body {i}"]
        rows.append((i, "\n".join(lines), host))
    rows += [(200, None, "a"), (201, "", "a"), (202, "only", "tiny"), (203, "only", "tiny")]
    docs = make_docs(rows)
    for limit in (200_000, 0):  # 0: never broadcast
        out = line_dedup.drop_boilerplate(docs, ratio=0.2, least_pages=3, broadcast_rows=limit).collect()
        assert {r.doc_id: r.text for r in out} == brute(rows, 0.2, 3)
        assert all(r["__line_dedup"].n_dropped == (1 if r.doc_id < 200 else 0) for r in out)


def test_other_columns_and_empty(make_docs):
    docs = make_docs([(i, "x\ny", "h") for i in range(5)]).withColumn("host", F.lit("clash")).withColumn("lines", F.lit(1))
    out = line_dedup.drop_boilerplate(docs)
    assert out.columns == [*docs.columns, "__line_dedup"]
    assert [r.text for r in out.collect()] == [""] * 5
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0


def allocated(spark):
    """Bytes that the JVM's living threads have allocated so far."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    bean = jvm.java.lang.management.ManagementFactory.getThreadMXBean()
    longs, of = jvm.java.lang.Class.forName("[J"), new(jvm.java.lang.Class, 1)
    of[0] = longs
    args = new(jvm.java.lang.Object, 1)
    args[0] = bean.getAllThreadIds()
    return sum(x for x in jvm.java.lang.Class.forName("com.sun.management.ThreadMXBean").getMethod("getThreadAllocatedBytes", of).invoke(bean, args) if x > 0)


def test_characters_are_no_objects(spark, make_docs):
    """Trimming made a Java object of each character, twice: gigabytes of garbage beside texts that fit in memory."""
    docs = make_docs([(i, "\n".join(f"row {i} {j} " + "word " * 400 for j in range(10)), "h") for i in range(300)]).cache()
    chars = docs.agg(F.sum("n_chars")).first()[0]
    line_dedup.drop_boilerplate(docs.limit(3)).count()
    before = allocated(spark)
    assert line_dedup.drop_boilerplate(docs).agg(F.sum(F.length("text"))).first()[0] == chars
    each = (allocated(spark) - before) / chars
    docs.unpersist()
    assert 0 < each < 60, each


def test_white_space_within_lines(make_docs):
    """A tab within a line counts as a space, wherever lines have one; what stays is unchanged."""
    docs = make_docs([(i, f"\r{['a b', 'a\tb', 'a\x0bb\t', ' a\x0cb'][i % 4]}\r\nrest\t{i} \x0c", "h") for i in range(8)])
    out = line_dedup.drop_boilerplate(docs, ratio=0.6).collect()
    assert {r.doc_id: r.text for r in out} == {i: f"rest\t{i} \x0c" for i in range(8)}
