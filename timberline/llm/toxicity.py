"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer rewrites each word as a symbol: insult or threat (with a weight), target, negator, intent, reporting verb, other;
punctuation adds the symbol of a clause's end. Five small machines read symbols, each on its own: insult, threat
(stronger after an intent), target (is anyone addressed in this clause), negation (of the last few words) and
reported speech. ``compose`` makes one transducer of them, whose states are the reachable tuples of theirs and whose output is what each says.
A match is an insult or threat on an arc of the composition: its kind, negated or not, reported or not, and, as the clause ends, aimed or not.
A clause's score is the sum of its matches' weights, each times its arc's weight; a document's score is a logistic function of
its clauses' scores and of nothing else, with weights that are not negative: another match never lowers it.

Insults and threats are a seed lexicon plus words and word stems learned from a bounded sample of labelled rows
(``FIT_ROWS``, least hash of doc_id first): all that are evident there, however many. The weights of arcs and of the logistic function come from
the same rows. Everything else covers all rows and whole texts. Only text enters a score. Null and empty texts get the score
of a text without matches. Without labels of both classes the seeds and default weights are used. Repeated rows are scored each;
a table without rows gives none; other columns of docs may have any names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm.common import discard, documents, materialize, text_or_empty

FIT_ROWS = 20_000
STEMS = range(4, 10)
LEAST_ODDS = 2.5
NEGATION_REACH = 3
MEMO = 500_000

OTHER, TARGET, NEGATOR, REPORT, INTENT, INSULT, THREAT, STOP = range(8)

INSULTS = "idiot idiots moron morons stupid scum loser losers trash pathetic worthless disgusting clown imbecile dumb vermin arschloch dummkopf idioten abschaum connard salaud imbécile crétin idiota imbécil basura escoria"
THREATS = "kill murder strangle stab töten umbringen tuer égorger matar"
TARGETS = "you your yours you're u he she they them him everyone people du dich dir dein deine ihr euch tu toi te vous votre ton tú ti usted ustedes vosotros"
NEGATORS = "not no never nor isn't aren't wasn't don't doesn't didn't cannot can't without nicht kein keine keinen nie niemals pas jamais aucun aucune sans no nunca jamás sin"
REPORTS = "said says quoted quotes wrote writes claimed claims reported reports called according allegedly sagte sagt schrieb zitierte laut dit dits écrit cité selon dijo dice escribió según"
INTENTS = "will gonna i'll we'll shall going werde werden wird vais va allons voy vamos"
DEFAULT = (-3.0, 0.8, 0.8, 0.4)
#: how much an arc counts before anything is learned
AIMED, NEGATED, REPORTED, INTENDED = 1.25, 0.5, 0.5, 1.5
#: sample rows that the prior weighs as much as
PRIOR_ROWS = 20.0

_CORE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_ENDS = (".", "!", "?", ";", ":", "…")


# --- machines ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Machine:
    """A transducer over symbols: step gives the next state and an output number."""

    start: int
    step: Callable[[int, int], tuple[int, int]]


def insult_machine() -> Machine:
    return Machine(0, lambda state, symbol: (0, int(symbol == INSULT)))


def threat_machine() -> Machine:
    """1 for a threat, 2 for one behind an intent in its clause."""
    return Machine(0, lambda intent, symbol: (0 if symbol == STOP else 1 if symbol == INTENT else intent, (1 + intent) if symbol == THREAT else 0))


def target_machine() -> Machine:
    """Whether the clause has named a target so far."""
    return Machine(0, lambda seen, symbol: (0 if symbol == STOP else 1 if symbol == TARGET else seen, seen))


def negation_machine(reach: int = NEGATION_REACH) -> Machine:
    """Whether one of the last words negates."""
    return Machine(0, lambda left, symbol: (0 if symbol == STOP else reach if symbol == NEGATOR else max(0, left - 1), int(left > 0)))


def report_machine() -> Machine:
    return Machine(0, lambda inside, symbol: (0 if symbol == STOP else 1 if symbol == REPORT else inside, inside))


MACHINES = (insult_machine, threat_machine, target_machine, negation_machine, report_machine)


@dataclass(frozen=True)
class Composition:
    """The product of machines as tables: following[state][symbol], and outputs[state][symbol], a tuple of their outputs."""

    following: list[list[int]]
    outputs: list[list[tuple[int, ...]]]


def compose(*machines: Machine) -> Composition:
    """All machines side by side: the states that can be reached from their starts."""
    first = tuple(m.start for m in machines)
    number, todo = {first: 0}, [first]
    following, outputs = [], []
    for states in todo:
        row, said = [], []
        for symbol in range(STOP + 1):
            steps = [m.step(s, symbol) for m, s in zip(machines, states)]
            to = tuple(s for s, _ in steps)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
            said.append(tuple(o for _, o in steps))
        following.append(row)
        outputs.append(said)
    return Composition(following, outputs)


ARCS = [(kind, aimed, negated, reported) for kind in (0, 1, 2) for aimed in (0, 1) for negated in (0, 1) for reported in (0, 1)]
ARC = {arc: i for i, arc in enumerate(ARCS)}


def prior_arcs() -> list[float]:
    """Weights of arcs (insult, threat, intended threat; aimed, negated, reported) that nothing is known of."""
    return [(INTENDED if kind == 2 else 1.0) * (AIMED if aimed else 1.0) * (NEGATED if negated else 1.0) * (REPORTED if reported else 1.0) for kind, aimed, negated, reported in ARCS]


@dataclass
class Grammar:
    """The learned parts: weights of words, of word stems, of arcs and of the logistic function."""

    words: dict[str, float] = field(default_factory=lambda: {w: 2.0 for w in f"{INSULTS} {THREATS}".split()})
    stems: dict[str, float] = field(default_factory=dict)
    arcs: list[float] = field(default_factory=prior_arcs)
    logistic: tuple[float, ...] = DEFAULT

    def weight(self, core: str) -> float:
        return max([self.words.get(core, 0.0), *(self.stems.get(core[:k], 0.0) for k in STEMS if len(core) >= k)])


class LexicalTransducer:
    """Word (with its punctuation) to (symbol, weight, ends a clause); memoized, the memo bounded."""

    def __init__(self, grammar: Grammar) -> None:
        self.grammar = grammar
        self.threats = frozenset(THREATS.split())
        self.fixed = {w: s for words, s in ((INTENTS, INTENT), (REPORTS, REPORT), (TARGETS, TARGET), (NEGATORS, NEGATOR)) for w in words.split()}
        self.known: set[bytes] = set()
        self.arcs: dict[bytes, tuple[int, float, bool]] = {}
        self.bearing: set[bytes] = set()
        self.machine = compose(*[make() for make in MACHINES])

    def _arc(self, token: bytes) -> None:
        text = token.decode("utf-8", "replace").lower()
        symbol, weight = OTHER, 0.0
        for core in _CORE.findall(text):
            if (w := self.grammar.weight(core)) > weight:
                symbol, weight = THREAT if core in self.threats else INSULT, w
            elif symbol == OTHER:
                symbol = self.fixed.get(core, OTHER)
        ends = text.endswith(_ENDS)
        self.known.add(token)
        if symbol or ends:
            self.arcs[token] = (symbol, weight, ends)
        if weight:
            self.bearing.add(token)

    def read(self, words: list[bytes]) -> bool:
        """Learns the arcs of words; whether any bears weight."""
        if len(self.known) > MEMO:
            self.known.clear()
            self.arcs.clear()
            self.bearing.clear()
        for token in set(words).difference(self.known):
            self._arc(token)
        return not self.bearing.isdisjoint(words)


def matches(words: list[bytes], lexical: LexicalTransducer) -> Iterator[list[tuple[int, float]]]:
    """Per clause its matches: (arc, weight of the word), as the composed transducer emits them."""
    following, outputs = lexical.machine.following, lexical.machine.outputs
    state, found = 0, []
    get, none = lexical.arcs.get, (OTHER, 0.0, False)

    def closed(aimed: int) -> list[tuple[int, float]]:
        return [(ARC[kind, aimed, negated, reported], weight) for kind, negated, reported, weight in found]

    for token in words:
        symbol, weight, ends = get(token, none)
        if symbol >= INSULT:
            insult, threat, _, negated, reported = outputs[state][symbol]
            found.append((0 if insult else threat, negated, reported, weight))
        state = following[state][symbol]
        if ends:
            yield closed(outputs[state][STOP][2])
            state, found = following[state][STOP], []
    if words and not ends:
        yield closed(outputs[state][STOP][2])


def facts(words: list[bytes], lexical: LexicalTransducer) -> tuple[float, ...]:
    """Inputs of the logistic function: the best clause's score, the sum of all (its logarithm), and the sum by the root of their number."""
    if not lexical.read(words):
        return (0.0,) * 3
    arcs, best, total, n = lexical.grammar.arcs, 0.0, 0.0, 0
    for clause in matches(words, lexical):
        n += 1
        if clause:
            score = sum(arcs[a] * w for a, w in clause)
            total += score
            best = max(best, score)
    return best, math.log1p(total), total / math.sqrt(n)


def logistic(weights: tuple[float, ...], x: tuple[float, ...]) -> float:
    z = weights[0] + sum(a * b for a, b in zip(weights[1:], x))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """t (UTF-8 text), toxic: at most ``rows`` training rows with distinct texts, those of least hash."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder() != 0))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", text_or_empty().alias("t")).join(F.broadcast(ids), "doc_id").select("doc_id", "t", "toxic")
    return found.dropDuplicates(["t"]).select(F.col("t").cast("binary").alias("t"), F.col("toxic").cast("int").alias("toxic"))


def _terms(text: bytes, wanted: frozenset | None) -> set[str]:
    """Words, and stems with a final *."""
    cores = {c for w in set(text.split()) for c in _CORE.findall(w.decode("utf-8", "replace").lower())}
    out = cores | {c[:k] + "*" for c in cores for k in STEMS if len(c) >= k}
    return out if wanted is None else out & wanted


def _counts(sample: DataFrame, wanted: frozenset | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def emit() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    seen.update(_terms(text, wanted))
                if len(seen) > 200_000:
                    yield emit()
                    seen.clear()
        yield emit()

    return sample.select("t").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def evidence(hit: int, miss: int, n1: int, n0: int) -> float:
    """-log of a bound on the chance that hit of hit + miss texts are toxic if the term means nothing."""
    n, q = hit + miss, n1 / (n1 + n0)
    p = hit / n
    if p <= q:
        return 0.0
    return n * (p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0.0))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Grammar:
    """A grammar from at most ``rows`` labelled rows.

    What reaches the driver is bounded by that sample: terms that a hundredth of its toxic rows have, and some numbers a row.
    """
    sample = materialize(labelled(docs, labels, rows), "labelled")
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    grammar = Grammar()
    if not n1 or not n0:
        return grammar
    support = max(3, math.ceil(0.01 * n1))
    often = _counts(sample.where("toxic = 1"), None).where(F.col("n") >= support).collect()
    hits = {r["term"]: r["n"] for r in often}
    misses = {r["term"]: r["n"] for r in _counts(sample.where("toxic = 0"), frozenset(hits)).collect()}
    odds = {t: math.log((n + 0.5) / (n1 + 1)) - math.log((misses.get(t, 0) + 0.5) / (n0 + 1)) for t, n in hits.items()}
    evident = math.log(100 * max(1, len(hits)))
    chosen = [t for t in odds if odds[t] >= LEAST_ODDS and evidence(hits[t], misses.get(t, 0), n1, n0) >= evident]
    words = {w: v for w, v in grammar.words.items() if odds.get(w, v) >= LEAST_ODDS / 2}
    words |= {t: odds[t] for t in chosen if not t.endswith("*")}
    grammar = Grammar(words, {t[:-1]: odds[t] for t in chosen if t.endswith("*")})

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexical = LexicalTransducer(grammar)
        for batch in batches:
            arcs = []
            for t in batch.column(0).to_pylist():
                words = t.split()
                arcs.append(sorted({a for clause in matches(words, lexical) for a, _ in clause}) if lexical.read(words) else [])
            yield pa.record_batch([pa.array(arcs, pa.list_(pa.int32())), batch.column(1)], ["arcs", "toxic"])

    # rows of either kind that an arc is on: 24 arcs
    on = sample.mapInArrow(seen, "arcs array<int>, toxic int").select(F.explode("arcs").alias("arc"), "toxic").groupBy("arc", "toxic").count().collect()
    grammar.arcs = learned_arcs({(r["arc"], int(r["toxic"] > 0)): r["count"] for r in on}, n1, n0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexical = LexicalTransducer(grammar)
        for batch in batches:
            x = [facts(t.split(), lexical) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    found = sample.mapInArrow(run, "x array<double>, toxic int").collect()
    x = np.array([r["x"] for r in found])
    y = np.array([float(r["toxic"] > 0) for r in found])
    grammar.logistic = tuple(not_negative(x, y))
    discard(sample)
    return grammar


def learned_arcs(on: dict[tuple[int, int], int], n1: int, n0: int) -> list[float]:
    """Weights of arcs: the prior's, moved by how much more (or less) an arc tells of toxic rows than matches do on the whole.

    An arc without rows keeps its prior weight; one with many goes by their log odds alone. None is negative.
    """
    rate = lambda hit, miss: math.log((hit + 0.5) / (n1 + 1)) - math.log((miss + 0.5) / (n0 + 1))
    all1, all0 = sum(on.get((a, 1), 0) for a in range(len(ARCS))), sum(on.get((a, 0), 0) for a in range(len(ARCS)))
    usual = max(0.1, rate(all1, all0))
    out = []
    for a, prior in enumerate(prior_arcs()):
        hit, miss = on.get((a, 1), 0), on.get((a, 0), 0)
        trust = (hit + miss) / (hit + miss + PRIOR_ROWS)
        out.append(max(0.0, (1 - trust) * prior + trust * min(3.0, rate(hit, miss) / usual)))
    return out


def not_negative(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the logistic function, inputs left out while their weights are negative."""
    used = list(range(x.shape[1]))
    while True:
        w = ridge_logistic(x[:, used], y)
        low = [i for i, v in zip(used, w[1:]) if v < 0]
        if not low:
            out = np.zeros(x.shape[1] + 1)
            out[0], out[[i + 1 for i in used]] = w[0], w[1:]
            return out
        used = [i for i in used if i != min(low, key=lambda i: w[1 + used.index(i)])]


def ridge_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Newton's method on the penalized likelihood; the intercept is free."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score, predicted for every row of docs, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexical = LexicalTransducer(grammar)
        for batch in batches:
            out: list[float] = []
            for at in range(0, batch.num_rows, 256):
                out += [logistic(grammar.logistic, facts(t.split(), lexical)) for t in batch.column(1).slice(at, 256).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("t")).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def nontoxic(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The rows of docs, all columns, whose score is under 0.5."""
    judged = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    at_text = [c.lower() for c in docs.columns].index("text")
    # a text that is a string is read from its row: sent beside it, it would be in memory twice
    beside = [] if isinstance(docs.schema[at_text].dataType, T.StringType) else [text_or_empty().cast("binary").alias("t")]

    def texts(part: pa.RecordBatch) -> list[bytes]:
        if part.num_columns > 1:
            return part.column(1).to_pylist()
        text = part.column(0).field(at_text)
        return [t or b"" for t in text.cast(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary()).to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexical = LexicalTransducer(grammar)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep = [logistic(grammar.logistic, facts(t.split(), lexical)) < 0.5 for t in texts(part)]
                part = part.filter(pa.array(keep, pa.bool_()))
                yield pa.record_batch([part.column(0)], ["row"])

    schema = docs.select(judged).schema
    return docs.select(judged, *beside).mapInArrow(run, schema).select("row.*")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    grammar = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, grammar)
    return out.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), "score", "predicted")
