"""Toxicity by a weighted finite-state pattern grammar.

Lexicons turn words into symbols: insult (I), threat (H), target (T), negation (N) and reported
speech (R); others are passed over.  Transducers with states and weighted arcs read a clause's
symbols: three mark the insults and threats that stand in the scope of a negation, a report or a
target, a fourth weighs them by their marks.  They are composed into one machine, and a clause's
score is its distance there, the best path's sum of weights.  A document's paths are added up by
arc, damped by a logarithm, and its score is the logistic of the arcs' learned weights; so matched
clauses count, not isolated words.

Learned from at most ``TRAIN_DOCUMENTS`` labelled documents (those whose doc_id has the smallest
hash): the insult lexicon - words and word beginnings that stand out in toxic documents, with the
logarithm of how much more often they do - and the arcs' weights.  A word counts by its own entry
or else by its longest listed beginning.  The words of the other lexicons are given, in the
languages of the corpus.

Defined results: a null or empty text has no clauses and gets the score of a text without matches;
a null doc_id is not held out; labels of doc_ids that are missing or null teach nothing; without
any labelled rows every score is that of the untrained grammar; repeated rows are scored each; an
empty table gives no rows; other columns don't matter; a text is read whole, however long it is.
"""

from __future__ import annotations

import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curalith.llm.storage import stored

#: The bound of the sample that is learned from.
TRAIN_DOCUMENTS = 20_000
#: How sure (log-likelihood ratio) and how much (log of the ratio of rates) a term must stand out.
SURE, MUCH = 15.0, 1.5
STEMS = (8, 7, 6, 5, 4)

# Fixed word lists of the given lexicons.
THREAT = frozenset("kill hurt destroy beat shoot stab burn töten schlagen vernichten umbringen tuer frapper détruire brûler matar golpear destruir quemar".split())
TARGET = frozenset("you your yours he she they them him her we us du dich dir ihr euch ihn sie er tu toi te vous il elle ils eux tú usted ustedes ellos ellas él".split())
NEGATION = frozenset("not no never isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás ningún".split())
REPORT = frozenset("said says wrote called quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())

WORD = regex.compile(r"[\p{L}\p{M}']+|[.!?;\n]+")

#: After so many words a negation, a report or a target counts no more.
REACH = 4


class Arc(NamedTuple):
    """Reads a symbol, writes another, has a weight (named, so that it can be learned) and leads on."""

    wrote: str
    weight: str
    to: tuple


class Transducer:
    """A weighted finite-state transducer over symbols.  Weights are scores in the semiring of max
    and plus: a path has the sum of its arcs' weights, a clause the best of its paths'.  All states
    are final, so that a clause may end anywhere."""

    def __init__(self, start: tuple, arcs: dict[tuple, dict[str, list[Arc]]]):
        self.start, self.arcs = start, arcs

    def written(self) -> set[str]:
        return {arc.wrote for by in self.arcs.values() for arcs in by.values() for arc in arcs}

    def compose(self, other: Transducer) -> Transducer:
        """Reads what this one reads and writes what the other makes of what this one writes."""
        start = self.start + other.start
        arcs: dict[tuple, dict[str, list[Arc]]] = {}
        n, todo = len(self.start), [start]
        while todo:
            state = todo.pop()
            if state in arcs:
                continue
            arcs[state] = own = {}
            for read, firsts in self.arcs[state[:n]].items():
                own[read] = [Arc(y.wrote, x.weight or y.weight, x.to + y.to) for x in firsts for y in other.arcs[state[n:]].get(x.wrote, [])]
                todo += [arc.to for arc in own[read]]
        return Transducer(start, arcs)

    def distance(self, symbols: list[tuple[str, float]], weights: dict[str, float]) -> float:
        """The best score over all paths that read the symbols, each of which scales its arc's weight."""
        best = {self.start: 0.0}
        for symbol, scale in symbols:
            onward: dict[tuple, float] = {}
            for state, score in best.items():
                for arc in self.arcs[state].get(symbol, []):
                    own = score + scale * weights.get(arc.weight, 0.0)
                    onward[arc.to] = max(own, onward.get(arc.to, -math.inf))
            best = onward
        return max(best.values(), default=-math.inf)


#: What words are for the grammar: insult, threat, target, negation, reported speech, anything else.
KINDS = "IHTNR."


def scope(opener: str, mark: str, alphabet: set[str]) -> Transducer:
    """Marks the insults and threats that stand at most REACH words after an opener."""
    arcs: dict[tuple, dict[str, list[Arc]]] = {}
    for left in range(REACH + 1):
        marked = lambda x, left=left: x + mark if left and x[0] in "IH" else x
        arcs[(left,)] = {x: [Arc(marked(x), "", (REACH if x == opener else max(0, left - 1),))] for x in alphabet}
    return Transducer((0,), arcs)


def hits(alphabet: set[str]) -> Transducer:
    """Weighs insults and threats by their marks; everything else passes without a weight."""
    return Transducer((0,), {(0,): {x: [Arc("hit" if x[0] in "IH" else "", x if x[0] in "IH" else "", (0,))] for x in alphabet}})


def composed() -> Transducer:
    """Negation, then reported speech, then target, then the weights of insults and threats."""
    machine = scope("N", "n", set(KINDS))
    for opener, mark in (("R", "r"), ("T", "a")):
        machine = machine.compose(scope(opener, mark, machine.written()))
    return machine.compose(hits(machine.written()))


MACHINE = composed()
#: The weights to learn: an insult (I) or threat (H), negated (n), reported (r), aimed at somebody (a).
ARCS = tuple(sorted({arc.weight for by in MACHINE.arcs.values() for arcs in by.values() for arc in arcs} - {""}))
#: Before anything is learned: negated and reported hits count less, aimed ones more.
PRIOR = {a: (2.0 if a[0] == "I" else 1.0) * (0.2 if "n" in a else 1.0) * (0.4 if "r" in a else 1.0) * (1.5 if "a" in a else 1.0) for a in ARCS} | {"words": 0.0}
PRIOR_BIAS = -2.0

# The machine's tables: it has one arc for each state and symbol.
_STATES = sorted(MACHINE.arcs)
_AT = {state: k for k, state in enumerate(_STATES)}
_NEXT = [[_AT[MACHINE.arcs[state][x][0].to] for x in KINDS] for state in _STATES]
_ARC = [[ARCS.index(w) if (w := MACHINE.arcs[state][x][0].weight) else -1 for x in KINDS] for state in _STATES]
_SKIPPED = [list(range(len(_STATES)))]  # the state after so many other words; after REACH it stays
for _ in range(REACH):
    _SKIPPED.append([_NEXT[k][KINDS.index(".")] for k in _SKIPPED[-1]])
_BEGUN, _ENDED = _AT[MACHINE.start], -1


class Symbols(dict):
    """The lexicons as a transducer of one state: a word to its symbol and weight, None for others.
    An exact entry counts, or else the longest listed beginning (with a star)."""

    def __init__(self, insults: dict[str, float]):
        super().__init__()
        self.insults = insults
        self.given = {w: (KINDS.index(kind), 1.0) for kind, words in (("R", REPORT), ("T", TARGET), ("N", NEGATION), ("H", THREAT)) for w in words}

    def __missing__(self, word: str) -> tuple[int, float] | None:
        if len(self) > 200_000:
            self.clear()
        found = None
        if word[0].isalpha():
            weight = self.insults.get(word)
            if weight is None and word not in self.given:
                weight = next((w for n in STEMS if len(word) > n and (w := self.insults.get(f"{word[:n]}*")) is not None), None)
            found = self.given.get(word) if weight is None else (KINDS.index("I"), weight)
        elif word[0] != "'":
            found = (_ENDED, 0.0)
        self[word] = found
        return found


class Grammar:
    """The lexicons, the composed machine and its arcs' weights."""

    def __init__(self, insults: dict[str, float], weights: dict[str, float], bias: float):
        self.insults, self.weights, self.bias = insults, weights, bias
        self.symbols = Symbols(insults)

    def clauses(self, text: str) -> list[tuple[str, float]]:
        """The clauses of a text and their distances by the machine."""
        out, words = [], []
        for word in [*WORD.findall(text.lower()), "."]:
            found = self.symbols[word]
            if found is not None and found[0] == _ENDED:
                if words:
                    read = [(KINDS[x[0]], x[1]) if x else (".", 1.0) for x in map(self.symbols.__getitem__, words)]
                    out.append((" ".join(words), MACHINE.distance(read, self.weights)))
                words = []
            else:
                words.append(word)
        return out

    def arcs(self, text: str) -> list[float]:
        """How much of each weight the paths of all clauses take, and the number of words (all as
        log(1 + x)): the machine's tables, run over the words that aren't passed over."""
        taken, words = [0.0] * len(ARCS), WORD.findall(text.lower())
        state, last, symbols = _BEGUN, -1, self.symbols
        for at, found in enumerate([symbols[w] for w in words]):
            if found is None:
                continue
            kind, scale = found
            if kind == _ENDED:
                state = _BEGUN
            else:
                state = _SKIPPED[min(at - last - 1, REACH)][state]
                arc = _ARC[state][kind]
                if arc >= 0:
                    taken[arc] += scale
                state = _NEXT[state][kind]
            last = at
        return [*map(math.log1p, taken), math.log1p(len(words))]

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[a] * x for a, x in zip((*ARCS, "words"), self.arcs(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def terms(text: str) -> set[str]:
    """The words of a text, and beginnings of its words (with a star)."""
    words = set(WORD.findall(text.lower()))
    words = {w for w in words if w[0].isalpha() and len(w) >= 3}
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def _counted(batches):
    """term, toxic documents and all documents with it; added up within a task as far as memory allows."""
    counts: dict[str, list[int]] = {}

    def emitted():
        kinds = (pa.string(), pa.int64(), pa.int64())
        rows = [(t, a, b) for t, (a, b) in counts.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["term", "toxic", "n"])

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for t in terms(text):
                own = counts.setdefault(t, [0, 0])
                own[0] += toxic
                own[1] += 1
            if len(counts) > 300_000:
                yield emitted()
                counts.clear()
    if counts:
        yield emitted()


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Newton steps for logistic regression with a Gaussian prior around ``prior``."""
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - strength * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(labelled: DataFrame) -> Grammar:
    """A grammar from ``labelled`` (text, toxic 0/1), a bounded sample; nothing else of a row is looked at."""
    rows = labelled.select("text", F.col("toxic").cast("long").alias("toxic")).filter("text IS NOT NULL AND toxic IN (0, 1)")
    # copies of a text would make its rare words look common
    sample = stored(rows.groupBy("text").agg(F.max("toxic").alias("toxic")).repartition(24), "labelled")
    total = sample.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    toxic, clean = total.toxic or 0, total.n - (total.toxic or 0)
    counts = sample.mapInArrow(_counted, "term string, toxic long, n long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("n").alias("n"))
    base = F.lit(toxic / max(1, total.n))
    part = lambda k, share: F.when(k > 0, k * F.log(k / (F.col("n") * share))).otherwise(0.0)
    sure = 2 * (part(F.col("t"), base) + part(F.col("n") - F.col("t"), 1 - base))
    much = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    # as many as stand out in the sample, which is bounded
    known = F.lit(0 < toxic < total.n)
    listed = counts.select("term", sure.alias("sure"), much.alias("much")).filter(known & (F.col("sure") >= SURE) & (F.col("much") >= MUCH))
    insults = {r.term: r.much for r in listed.orderBy(F.desc("sure"), "term").collect()}

    def measured(batches):
        grammar = Grammar(insults, PRIOR, PRIOR_BIAS)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([grammar.arcs(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))], names=["toxic", "arcs"])

    data = sample.mapInArrow(measured, "toxic long, arcs array<double>").collect()  # TRAIN_DOCUMENTS rows of a few numbers
    prior = np.array([PRIOR_BIAS, *(PRIOR[a] for a in (*ARCS, "words"))])
    w = prior
    if data:
        x, y = np.array([[1.0, *r.arcs] for r in data]), np.array([float(r.toxic) for r in data])
        w = _logistic(x, y, prior)
        if w[-1] > 0:  # length excuses chance hits; it never makes a text toxic
            x[:, -1] = 0
            w = _logistic(x, y, prior)
    return Grammar(insults, dict(zip((*ARCS, "words"), w[1:].tolist(), strict=True)), float(w[0]))


def toxic_score(grammar: Grammar):
    """A function from a text column to its score, from 0 to 1."""
    insults, weights, bias = tuple(grammar.insults.items()), tuple(grammar.weights.items()), grammar.bias

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        own = _kept(insults, weights, bias)
        return texts.fillna("").map(own.score).astype(float)

    return scored


@lru_cache(maxsize=1)
def _kept(insults: tuple, weights: tuple, bias: float) -> Grammar:
    """One grammar for all batches of a Python worker."""
    return Grammar(dict(insults), dict(weights), bias)


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained_on(docs: DataFrame, labels: DataFrame) -> Grammar:
    """A grammar from at most TRAIN_DOCUMENTS of the labelled documents that aren't held out: few
    enough labels to go to the documents, so that no text is shuffled but theirs."""
    known = labels.select("doc_id", "toxic").filter(~held_out("doc_id") & F.col("toxic").isin(0, 1))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(TRAIN_DOCUMENTS)
    return train(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    grammar = trained_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), toxic_score(grammar)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
