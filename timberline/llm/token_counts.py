"""Token counts: an exact length histogram with suffix sums.

One pass turns documents into encoded lengths; a partially aggregated count by
length is the only shuffle. Suffix sums over the histogram then answer, for any
context limit, how many documents reach it, how many tokens lie beyond and what
truncation leaves. Null texts count as empty (length 0), repeated rows count
each, an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.llm.common import documents, materialize, text_or_empty
from timberline.llm.tokens import default_tokenizer, encoder

BLOCK = 1024


def encoded_lengths(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """n_tokens of each row's whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        for batch in batches:
            texts, lengths = batch.column(0), []
            for at in range(0, batch.num_rows, 256):
                lengths += [len(x) // 4 for x in encode(texts.slice(at, 256).to_pylist())]
            yield pa.record_batch([pa.array(lengths, pa.int64())], ["n_tokens"])

    return docs.select(text_or_empty(text).cast("binary").alias("t")).mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per distinct length, with suffix sums over it and all greater lengths.

    Columns: n_tokens, n_docs, docs_at_least, tokens_at_least, truncated_tokens
    (what is left if every document is cut at n_tokens) and cdf (share of
    documents of at most n_tokens: the first row at which cdf reaches q is the
    q-quantile). Suffix sums run inside blocks of lengths, then over block totals, so
    no task sorts all lengths.
    """
    hist = materialize(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("mass", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("mass").alias("m"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("m").over(later), F.lit(0)).alias("mass_above"),
        F.sum("d").over(whole).alias("all_docs"),
        F.sum("m").over(whole).alias("all_mass"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("d_in", F.sum("n_docs").over(inside)).withColumn("m_in", F.sum("mass").over(inside)).join(blocks, "block")
    at_least, tokens = F.col("d_in") + F.col("docs_above"), F.col("m_in") + F.col("mass_above")
    return hist.select(
        "n_tokens",
        "n_docs",
        at_least.alias("docs_at_least"),
        tokens.alias("tokens_at_least"),
        (F.col("all_mass") - tokens + at_least * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("all_docs") - at_least + F.col("n_docs")) / F.col("all_docs")).alias("cdf"),
    )


def totals_at(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: documents over limit, all tokens, and the tokens that truncation at limit leaves."""
    return histogram.agg(
        F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.col("n_docs") * F.least(F.col("n_tokens"), F.lit(limit))), F.lit(0)).alias("tokens_kept"),
    )


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row: the least length that at least a share q of the documents doesn't exceed."""
    return histogram.where(F.col("cdf") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(documents(spark, sf_dir), default_tokenizer()))
