"""Toxicity by composed weighted transducers over clauses.

A text's clauses are runs of words between sentence marks. Words are read as
classes: insult and threat words and stems (learned, with weights, from labelled
documents, beside a short fixed list; a threat is what mostly stands after words of
intent), targets, negations, verbs of speech, quotation marks. Small transducers, one each for insult, threat, target,
negation and reported speech, are composed into one deterministic machine; its
output over a clause is the clause's score, and a logistic model of the matched
clauses' scores gives the document's.
"""

from __future__ import annotations

import itertools
import math
import re
from dataclasses import dataclass, replace

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.plans.shared import written

#: Labelled documents, at most about so many, from which all is learned.
TRAIN_DOCS = 24_000
#: Words of the learned lexicon, at most, and the least weight and toxic documents of one.
WORDS, LEAST_WEIGHT, LEAST_DOCS = 1500, 1.5, 6
THRESHOLD = 0.3
#: Where labels don't tell toxic from other documents: the toxic share of two rows that are added to them.
PRIOR = 0.1
#: Letters of a stem, and of the words that have one.
STEM, STEMMED = 5, 7
#: A learned word is a threat if at least this part of the toxic documents with it have it after words of intent.
THREAT_SHARE = 0.5

OTHER, INSULT, THREAT, TARGET, NEGATION, SPEECH, QUOTE = range(7)
FIXED = {
    THREAT: "kill hurt destroy beat shoot stab murder töten umbringen verletzen tuer blesser frapper matar herir golpear",
    TARGET: "you your yours u he she him her they them these those people du dich dir ihr euch sie er tu te toi vous ton ta il elle ils elles tú usted ustedes él ella ellos",
    NEGATION: "not no never none neither nor without isn't aren't don't nicht kein keine nie ohne ne pas jamais sans nunca jamás sin ni",
    SPEECH: "said says say wrote writes called calls claimed quoted reported sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó",
}
#: Words of intent, up to two words before what is intended.
INTENT = r"(?<!\p{L})(?:will|shall|gonna|going to|i'll|we'll|werde|werden|vais|allons|voy a|vamos a)\s+(?:\p{L}+\s+){0,2}?(\p{L}{2,})"
_CLAUSE = re.compile(r"[^.!?;\n]+")
_TOKEN = re.compile(r"[\w']+|[\"“”„«»]")
#: How long a negation reaches, in words.
REACH = 3


@dataclass(frozen=True)
class Transducer:
    """step(state, class) -> (next state, factor on a matched word's weight, weight added)."""

    start: int
    states: tuple[int, ...]
    step: object


def insult() -> Transducer:
    """Matches insult words; a second one in the clause counts half as much again."""
    return Transducer(0, (0, 1), lambda s, c: (1, 1.25 if s else 1.0, 0.0) if c == INSULT else (s, 1.0, 0.0))


def threat() -> Transducer:
    """Matches threat words; after a target they weigh more."""
    return Transducer(0, (0, 1), lambda s, c: (1, 1.0, 0.0) if c == TARGET else (s, 1.3 if s and c == THREAT else 1.0, 0.0))


def target() -> Transducer:
    """An insult near whom it is aimed at weighs more; a target after it adds a little."""
    def step(s, c):
        if c == TARGET:
            return 1 | s, 1.0, 0.2 if s & 2 and not s & 1 else 0.0
        return (s | 2 if c in (INSULT, THREAT) else s), 1.2 if s & 1 else 1.0, 0.0

    return Transducer(0, (0, 1, 2, 3), step)


def negation() -> Transducer:
    """What a negation reaches weighs half."""
    return Transducer(0, tuple(range(REACH + 1)), lambda s, c: (REACH, 1.0, 0.0) if c == NEGATION else (max(0, s - 1), 0.5 if s else 1.0, 0.0))


def reported() -> Transducer:
    """Reported speech, between a verb of speech's quotation marks, weighs half."""
    def step(s, c):
        if c == SPEECH:
            return max(s, 1), 1.0, 0.0
        if c == QUOTE:
            return (2 if s == 1 else 0), 1.0, 0.0
        return s, 0.5 if s == 2 else 0.8 if s == 1 else 1.0, 0.0

    return Transducer(0, (0, 1, 2), step)


def composed(parts: list[Transducer]) -> tuple[list[list[int]], list[list[float]], list[list[float]]]:
    """The product machine: next state, factor and addition by state and class; state 0 is the start."""
    every = list(itertools.product(*[p.states for p in parts]))
    every.sort(key=lambda s: s != tuple(p.start for p in parts))
    number = {s: i for i, s in enumerate(every)}
    to, factor, added = [], [], []
    for state in every:
        rows = []
        for c in range(7):
            got = [p.step(s, c) for p, s in zip(parts, state, strict=True)]
            rows.append((number[tuple(g[0] for g in got)], math.prod(g[1] for g in got), sum(g[2] for g in got)))
        for out, k in ((to, 0), (factor, 1), (added, 2)):
            out.append([r[k] for r in rows])
    return to, factor, added


class Grammar:
    """Scores the clauses of a text in which an insult or a threat stands."""

    def __init__(self, weights: dict[str, float], threats: frozenset[str] = frozenset(), stems: dict[str, float] | None = None):
        self.classes = {w: c for c, ws in FIXED.items() for w in ws.split()}
        self.weights = {w: 1.0 for w in FIXED[THREAT].split()}
        for w, x in weights.items():
            self.weights[w] = x
            if self.classes.get(w) not in (THREAT, TARGET, NEGATION, SPEECH):
                self.classes[w] = THREAT if w in threats else INSULT
        self.weights = {w: x for w, x in self.weights.items() if self.classes[w] in (INSULT, THREAT)}
        self.stems = stems or {}
        self.machine = composed([insult(), threat(), target(), negation(), reported()])
        self.finder = ahocorasick.Automaton()
        for w in {*self.weights, *self.stems}:
            self.finder.add_word(w, (len(w), w in self.weights, w in self.stems))
        if self.weights or self.stems:
            self.finder.make_automaton()

    def read(self, token: str) -> tuple[int, float]:
        """A token's class and weight."""
        c = self.classes.get(token)
        if c is None and len(token) >= STEMMED and token[:STEM] in self.stems:
            return INSULT, self.stems[token[:STEM]]
        return (QUOTE if token in "\"“”„«»" else OTHER) if c is None else c, self.weights.get(token, 0.0)

    def clause(self, text: str) -> float:
        to, factor, added = self.machine
        state, total = 0, 0.0
        for token in _TOKEN.findall(text):
            c, weight = self.read(token)
            total += added[state][c] + (weight * factor[state][c] if c in (INSULT, THREAT) else 0.0)
            state = to[state][c]
        return total

    def features(self, text: str | None) -> tuple[float, float, float]:
        """The highest clause score, the log of all scores' sum, and the clauses that matched for a word of text."""
        if not text or not (self.weights or self.stems):
            return 0.0, 0.0, 0.0
        low = text.lower()
        scores, done = [], -1
        for end, (n, whole, stem) in self.finder.iter(low):
            a, b = end - n + 1, end + 1
            ends = b >= len(low) or not (low[b].isalnum() or low[b] == "_")
            if a < done or (a and (low[a - 1].isalnum() or low[a - 1] == "_")) or not (whole and ends or stem and low[b : b + STEMMED - STEM].isalpha() and b + STEMMED - STEM <= len(low)):
                continue
            begin = max(low.rfind(x, done if done > 0 else 0, a) for x in ".!?;\n") + 1
            m = _CLAUSE.match(low, begin)
            stop = max(m.end() if m else b, b)
            scores.append(self.clause(low[begin:stop]))
            done = stop
        if not scores:
            return 0.0, 0.0, 0.0
        return max(scores), math.log1p(max(0.0, sum(scores))), min(1.0, 10 * len(scores) / (len(low) / 6 + 10))


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    slopes: tuple[float, float, float]
    threats: frozenset[str] = frozenset()
    stems: dict[str, float] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ np.array(self.slopes), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights, the bias first, by Newton's method with a small ridge."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.01 * w)
    return w


def _features(grammar: Grammar):
    def run(batches):
        for batch in batches:
            x = np.array([grammar.features(t) for t in batch.column("text").to_pylist()], float).reshape(-1, 3)
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(x[:, k].copy()) for k in range(3))], names=[*rest, "f0", "f1", "f2"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> Model:
    """Learn from (doc_id, text) and (doc_id, toxic); rows with a null label or id don't count.

    A sample of about max_docs labelled documents, chosen by a hash of doc_id, is
    used; the words and stems (WORDS of each at most) and the sample's three
    features each come to the driver. The scores' weights are fitted on documents
    that the words which they are scored by were not learned from: two halves of
    the sample, each by the other's words, if both have both labels.
    Rows that repeat a doc_id count each, with its greatest label. Without both
    labels every score is the labels' mean, smoothed by PRIOR: without any, PRIOR
    itself, which marks nothing as toxic. Null texts are left out, other columns not read.
    """
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = rows.count()
    if total > max_docs:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_docs / total))
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int")
    rows = written(docs.select("doc_id", "text").where("text is not null").join(rows, "doc_id").select(half.alias("half"), "toxic", F.lower("text").alias("text")), "labelled")
    n = {(r.half, r.toxic > 0): r.n for r in rows.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = (sum(x for (_, y), x in n.items() if y == of) for of in (True, False))
    if not n1 or not n0:
        p = (n1 + 2 * PRIOR) / (n1 + n0 + 2)
        return Model({}, math.log(p / (1 - p)), (0.0, 0.0, 0.0))
    apart = all(n.get((h, y), 0) >= LEAST_DOCS for h in (0, 1) for y in (True, False))
    model = _lexicon(rows, n1, n0)
    halves = [(_lexicon(rows.where(F.col("half") == h), n[h, True], n[h, False]), rows.where(F.col("half") != h)) for h in (0, 1)] if apart else [(model, rows)]
    got = pd.concat([of.select("toxic", "text").mapInArrow(_features(grammar_of(m)), "toxic int, f0 double, f1 double, f2 double").toPandas() for m, of in halves])
    w = _logistic(got[["f0", "f1", "f2"]].to_numpy(), (got["toxic"] > 0).to_numpy(float))
    return replace(model, bias=float(w[0]), slopes=tuple(float(x) for x in w[1:]))


def _lexicon(rows: DataFrame, n1: int, n0: int) -> Model:
    """Words, stems and which words are threats, from rows (toxic, text) of n1 toxic and n0 other documents."""

    def learned(words) -> list:
        """(word, weight, n1) of an array column, the heaviest."""
        counts = rows.select("toxic", F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.sum("toxic").alias("n1"), F.count("*").alias("n")).where(F.col("n1") >= LEAST_DOCS)
        weight = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n") - F.col("n1") + 0.5) / (n0 + 1))
        return counts.withColumn("w", weight).where(F.col("w") >= LEAST_WEIGHT).orderBy(F.desc("w"), "word").limit(WORDS).collect()

    all_words = F.regexp_extract_all("text", F.lit(r"\p{L}{2,}"), F.lit(0))
    top = learned(all_words)
    stems = learned(F.transform(F.filter(all_words, lambda w: F.length(w) >= STEMMED), lambda w: F.substring(w, 1, STEM)))
    meant = rows.where("toxic > 0").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(INTENT), F.lit(1)))).alias("word")).groupBy("word").agg(F.count("*").alias("k"))
    meant = {r.word: r.k for r in meant.where(F.col("word").isin([r.word for r in top])).collect()} if top else {}
    threats = frozenset(r.word for r in top if meant.get(r.word, 0) >= THREAT_SHARE * r.n1)
    return Model({r.word: r.w for r in top}, 0.0, (0.0, 0.0, 0.0), threats, {r.word: r.w for r in stems})


def grammar_of(model: Model) -> Grammar:
    return Grammar(model.weights, model.threats, model.stems)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted, best_clause of every document, each by its own text alone.

    A null or empty text has the score of no match. Rows that repeat a doc_id, or
    that have none, have a row each; other columns are not read; an empty table
    gives an empty result.
    """
    grammar = grammar_of(model)
    rows = docs.select("doc_id", "text").mapInArrow(_features(grammar), "doc_id bigint, f0 double, f1 double, f2 double")
    z = F.lit(model.bias) + sum((F.col(f"f{k}") * float(s) for k, s in enumerate(model.slopes)), F.lit(0.0))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))
    return rows.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.col("f0").alias("best_clause"))
