"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and
returns a DataFrame, which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timberline.llm import common, stages

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_boilerplate_lines),
    ("simhash_near_dedup", stages.drop_near_duplicates),
    ("mixing", stages.mix_sources),
    ("packing", stages.pack_sequences),
]

#: No stage but line dedup can be said in SQL; tests compare run() with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, name)
    return docs
