"""Mixing sources to target weights by the cube method.

Every source gets a target (its weight's share of all sizes, at most ``most``
times its own size, the excess reshared by weight). A document of a source with
ratio r = target / size is taken floor(r) times, and once more with probability
r - floor(r). The cube method draws these last copies: the vector of inclusion
probabilities moves inside the null space of the constraints (number of documents and their
sizes) until nearly all entries are 0 or 1, so both totals stay exact. The flight
runs in hashed chunks of a source; what is left undecided in each (no more than
the constraints) meets in larger chunks until one small landing problem per
source remains, which goes to the nearest size.

Null texts have size 0 and are taken 0 words; null sources are one source, the
last. Equal rows are interchangeable. Draws depend on doc_id and the seed alone,
so reruns agree.
"""

from __future__ import annotations

import math
import random
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import WORD, documents, materialize

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
CHUNK = 20_000
SEED = 20


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Weighted shares of the sum of sizes, none above most times its size."""
    total, left = float(sum(sizes)), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while left:
        mass = sum(weights[i] for i in left)
        over = [i for i in left if total * weights[i] / mass > most * sizes[i]]
        if not over:
            for i in left:
                out[i] = total * weights[i] / mass
            break
        for i in over:
            out[i] = most * sizes[i]
            total -= out[i]
            left.discard(i)
        total = max(total, 0.0)
    return out


def flight(sizes: list[int], p: list[float], rng: random.Random, constraints: int = 2) -> None:
    """Moves p in place, keeping sum(p) and sum(p * size), until at most ``constraints`` entries are fractional."""
    eps = 1e-9
    todo = iter([i for i, x in enumerate(p) if eps < x < 1 - eps])
    live: list[int] = []
    while True:
        while len(live) < 3:
            i = next(todo, None)
            if i is None:
                break
            live.append(i)
        if len(live) < 2 or (len(live) < 3 and sizes[live[0]] != sizes[live[1]]):
            break
        a, b = live[0], live[1]
        if len(live) == 3:
            c = live[2]
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if u == (0, 0, 0):
                u = (1, -1, 0)
            scale = max(abs(x) for x in u)
            u = tuple(x / scale for x in u)
        else:
            u = (1.0, -1.0)
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(live, u) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(live, u) if x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(live, u):
            p[i] = min(1.0, max(0.0, p[i] + step * x))
            if p[i] < eps or p[i] > 1 - eps:
                p[i] = float(round(p[i]))
        live = [i for i in live if 0.0 < p[i] < 1.0]


def landing(sizes: list[int], p: list[float]) -> None:
    """Decides the few fractional entries: the choice nearest in size, then in number."""
    live = [i for i, x in enumerate(p) if 0.0 < x < 1.0]
    size, number = sum(p[i] * sizes[i] for i in live), sum(p[i] for i in live)
    best = min(product((0, 1), repeat=len(live)), key=lambda c: (abs(sum(sizes[i] for i, x in zip(live, c) if x) - size), abs(sum(c) - number), c))
    for i, x in zip(live, best):
        p[i] = float(x)


def _fly(rows: DataFrame, land: bool, seed: int) -> DataFrame:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["order", "doc_id", "size"], kind="stable").reset_index(drop=True)
        sizes, p = part["size"].tolist(), part["p"].tolist()
        rng = random.Random(f"{seed} {part['src'].iloc[0]} {part['chunk'].iloc[0]} {len(p)}")
        flight(sizes, p, rng)
        if land:
            landing(sizes, p)
        part["p"] = p
        return part

    return rows.groupBy("src", "chunk").applyInPandas(run, rows.schema)


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> list[tuple]:
    """(source, rank, size, target) by code point order of sources, null last; one small row per source comes to the driver."""
    found = sized.groupBy("source").agg(F.sum("size").alias("s")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [int(r["s"]) for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], most)
    return [(r["source"], i, s, t) for i, (r, s, t) in enumerate(zip(found, sizes, goal))]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every document."""
    spark = docs.sparkSession
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size")), "sized")
    plan = source_targets(sized, weights, most)
    table = spark.createDataFrame(
        [(s, i, n, t, math.floor(t / n + 1e-12) if n else 0, max(0.0, t / n - math.floor(t / n + 1e-12)) if n else 0.0) for s, i, n, t in plan],
        "source string, src int, source_size long, target double, base int, p double",
    )
    rows = sized.join(table.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # an empty document satisfies every constraint either way: it is never undecided
    rows = rows.withColumn("p", F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.col("p"))).withColumn("order", F.xxhash64("doc_id", "size", F.lit(seed)))
    undecided = rows.where("p > 0").select("doc_id", "size", "src", "p", "order")
    done = rows.where("p <= 0").select("doc_id", "size", "src", "p")
    most_rows = sized.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    chunks, level = max(1, -(-most_rows // chunk)), 0
    while True:
        flown = _fly(undecided.withColumn("chunk", F.pmod(F.xxhash64("order", F.lit(level)), F.lit(chunks))), chunks == 1, seed + level)
        flown = materialize(flown.select("doc_id", "size", "src", "p", "order"), f"flight{level}")
        done = done.unionByName(flown.where("p = 0 or p = 1").select("doc_id", "size", "src", "p"))
        if chunks == 1:
            break
        undecided, chunks, level = flown.where("p > 0 and p < 1"), max(1, -(-2 * chunks // chunk)), level + 1
    facts = table.select("src", "source", "source_size", "target", "base")
    out = done.join(facts, "src").withColumn("copies", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("base") + F.col("p").cast("int")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
