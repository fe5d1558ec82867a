"""Quality rules on repetition, by a suffix array with longest common prefixes.

The words of each text get a suffix array by prefix doubling (many texts at a time; words
are numbered per text, so no repeat crosses texts). A suffix's longest common prefix with its
neighbours in suffix order is the length of the maximal repeated substring that starts
there. Repeats of at least ``LEAST`` words cover spans; their union must stay below a
fraction of the text, and the longest repeat below a length. Base rules come first: too few words,
or over half of the words in repeated 3-word windows.

Null and empty texts have no words, fail the base rules and are not kept. Repeated rows are
judged each. Texts are taken whole; memory follows the longest text, not the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import WORD, documents, text_or_empty

LEAST = 8
MOST_COVERED = 0.35
LONGEST = 0.1
LONGEST_WORDS = 40
LEAST_WORDS = 50
CHUNK_BYTES = 2_000_000
#: texts of more words than this have their common prefixes found in one pass over the text, which needs less memory
KASAI = 600_000


def suffix_ranks(ids: np.ndarray, last: bool = False) -> list[tuple[int, np.ndarray]]:
    """Prefix doubling: (length, ranks) for lengths 1, 2, 4, ... until all ranks differ; with ``last`` only the last ones are kept.

    Two places have one rank at a length iff that many following words agree. A rank is
    the first place of its group in suffix order, so later rounds refine only groups of two or more.
    """
    n = len(ids)
    key, length = ids.astype(np.int64), 1
    rank, active = np.zeros(n, np.int64), np.arange(n)
    levels: list[tuple[int, np.ndarray]] = []
    while len(active):
        old = rank[active]
        order = np.argsort(key, kind="stable")
        sorted_key, sorted_old = key[order], old[order]
        place = np.arange(len(order))
        fresh = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
        first = np.r_[True, sorted_old[1:] != sorted_old[:-1]]
        start = np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        if last:
            levels.clear()
        else:
            rank = rank.copy()
        rank[active[order]] = sorted_old + start
        levels.append((length, rank))
        group = np.cumsum(fresh) - 1
        active = active[order[np.bincount(group)[group] > 1]]
        ahead = active + length
        following = np.full(len(active), -1, np.int64)
        inside = ahead < n
        following[inside] = rank[ahead[inside]]
        key, length = rank[active] * (n + 1) + following + 1, length * 2
    return levels


def neighbour_lcps(ids: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Each suffix's common prefix with the one before it in suffix order, by Kasai's pass over the text: linear, no ranks of levels."""
    n = len(ids)
    out = np.zeros(n, np.int64)
    word, before, place, lcp = memoryview(ids), memoryview(order), memoryview(rank), memoryview(out)
    h = 0
    for i in range(n):
        at = place[i]
        if not at:
            h = 0
            continue
        j = before[at - 1]
        while i + h < n and j + h < n and word[i + h] == word[j + h]:
            h += 1
        lcp[at] = h
        if h:
            h -= 1
    return out


def longest_repeats(ids: np.ndarray) -> np.ndarray:
    """For each place, the length in words of the longest repeat that starts there.

    ids number the words; equal words of one text have equal ids, and no id is in two texts.
    """
    n = len(ids)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    if n > KASAI:
        rank = suffix_ranks(ids, last=True)[-1][1]
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        lcp = neighbour_lcps(ids, order, rank)
        np.maximum.at(longest, order[1:], lcp[1:])
        np.maximum.at(longest, order[:-1], lcp[1:])
        return longest
    levels = suffix_ranks(ids)
    order = np.argsort(levels[-1][1], kind="stable")
    # only neighbours that share a word can share more
    a, b = order[:-1], order[1:]
    one = ids[a] == ids[b]
    a, b = a[one], b[one]
    x, y, lcp = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for length, rank in reversed(levels):
        same = (x < n) & (y < n)
        same[same] = rank[x[same]] == rank[y[same]]
        lcp[same] += length
        x[same] += length
        y[same] += length
    np.maximum.at(longest, a, lcp)
    np.maximum.at(longest, b, lcp)
    return longest


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def text_facts(texts: list[bytes], least: int = LEAST) -> list[np.ndarray]:
    """n_words, n_repeat_words, n_covered_words and longest_repeat of each UTF-8 text."""
    ids: list[int] = []
    counts, base = [], 0
    for text in texts:
        words = text.split()
        number: dict[bytes, int] = {}
        ids += [base + number.setdefault(w, len(number)) for w in words]
        base += len(number)
        counts.append(len(words))
    n = len(ids)
    of = np.repeat(np.arange(len(texts)), counts)
    longest = longest_repeats(np.array(ids, np.int64))
    three = np.flatnonzero(longest >= 3)
    far = np.flatnonzero(longest >= least)
    repeat = np.bincount(of[_covered(three, np.full(len(three), 3), n)], minlength=len(texts))
    cover = np.bincount(of[_covered(far, longest[far], n)], minlength=len(texts))
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, of, longest)
    top[top < 3] = 0
    return [np.array(counts, np.int64), repeat, cover, top]


def repetition_facts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with column ``rep``: struct of n_words, n_repeat_words, n_covered_words, longest_repeat; text is dropped."""
    rest = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest) + ", n_words long, n_repeat_words long, n_covered_words long, longest_repeat long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            lengths = np.array(pa.compute.binary_length(texts))
            cut = np.flatnonzero(np.diff(np.cumsum(lengths) // CHUNK_BYTES)) + 1
            facts: list[list[np.ndarray]] = [text_facts(texts.slice(a, b - a).to_pylist(), least) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]) if b > a]
            columns = [pa.array(np.concatenate(c)) for c in zip(*facts)] if facts else [pa.array([], pa.int64())] * 4
            yield pa.record_batch([*batch.columns[1:], *columns], [*rest, "n_words", "n_repeat_words", "n_covered_words", "longest_repeat"])

    return docs.select(text_or_empty().cast("binary").alias("text"), *rest).mapInArrow(run, schema)


def judge(docs: DataFrame, least: int = LEAST, most_covered: float = MOST_COVERED, longest: float = LONGEST, longest_words: int = LONGEST_WORDS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the method's covered words and longest repeat."""
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    facts = repetition_facts(counted, least)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    bad = (F.col("n_covered_words") > most_covered * F.col("n_words")) | ((F.col("longest_repeat") > longest_words) & (F.col("longest_repeat") > longest * F.col("n_words")))
    return facts.withColumn("base_failed", failed).withColumn("kept", ~failed & ~bad)


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered_words", "longest_repeat")
