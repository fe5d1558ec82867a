"""Pipeline stages: operators applied to a table with the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.llm import line_dedup, mixing, packing, simhash, toxicity


def _row(docs: DataFrame, text: str = "text") -> list:
    """The columns of docs, with n_chars of the text as it is now (0 of a null)."""
    return [F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under 0.5; learns from labels of documents that are in docs."""
    return toxicity.nontoxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, less lines that too many documents of their source have."""
    return line_dedup.drop_boilerplate(docs).select(*_row(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that op 6 links at a similarity of 0.8 of 5-word shingles: that of least doc_id, nulls last."""
    return simhash.one_of_each_group(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it.

    Rows that share doc_id, source and size are interchangeable to the mix: as many of them as it draws once more, in
    order of their texts, are taken once more. An empty table gives no rows; columns of docs are kept in a struct, so their names are free.
    """
    drawn = mixing.mix(docs).groupBy("doc_id", "source", "size").agg(F.min("copies").alias("base"), F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("all"))
    more = (F.col("all") - F.col("rows") * F.col("base")).alias("more")
    plan = drawn.select(F.struct("doc_id", "source", "size", "base", "rows", more).alias("plan"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    mine = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("of"), mixing.word_count().alias("words"))
    p = F.col("plan")
    joined = mine.join(plan, F.col("id").eqNullSafe(p["doc_id"]) & F.col("of").eqNullSafe(p["source"]) & (F.col("words") == p["size"]))
    split = (p["more"] > 0) & (p["more"] < p["rows"])
    whole = joined.where(~split).select("row", (p["base"] + F.when(p["more"] > 0, 1).otherwise(0)).alias("times"))
    place = F.row_number().over(Window.partitionBy("id", "of", "words").orderBy(F.md5(F.col("row.text").cast("binary"))))
    parted = joined.where(split).select("row", (p["base"] + F.when(place <= p["more"], 1).otherwise(0)).alias("times"))
    return whole.unionByName(parted).select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, packed into sequences."""
    return packing.pack_documents(docs, forget=True)
