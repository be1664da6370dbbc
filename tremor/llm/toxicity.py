"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon turns the words of a clause into symbols: abuse, violence, target, negation, report, other. Abuse and violence are words
and word beginnings that labelled texts teach, beside a short seed list; a taught word that mostly aims at a target, as "kill" does at
"you", is violence, any other abuse. Five transducers then read that string one after the other: *insult* marks abuse, heavier where it is heaped,
*threat* marks violence that reaches a target, *target* makes insults heavier after one was named, *negation* weakens a mark that follows
closely, and *reported speech* weakens what follows it in the clause. They are composed into one table before any
text is read. A clause scores its heaviest mark: the weight of the word times the factors on the way. A logistic curve over the
best clause, the sum of clauses and their density turns that into a probability.

Fitting uses a bounded sample (``sample_rows`` labelled documents in expectation), which also bounds the lexicon: terms of three toxic texts of it.

Defined results: null and empty texts score as texts without any match; repeated rows score alike; a document that
labels names twice counts twice in fitting; of clauses that score alike the first is the top one; with no labels at all the curve is a fixed
prior; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .language_id import bounded_sample, held_out

OTHER, ABUSE, VIOLENCE, TARGET, NEGATION, REPORT, INSULT, THREAT = range(8)
#: Seed words by symbol, for English, German, French and Spanish.
SEEDS = {
    ABUSE: "idiot moron stupid pathetic worthless disgusting scum trash loser imbecile",
    VIOLENCE: "kill hurt destroy shoot stab strangle töten umbringen erschießen tuer frapper matar golpear",
    TARGET: "you your yours he him she her they them their these those people du dich dir ihr euch sie tu toi vous ils elles tú ti usted ustedes ellos ellas",
    NEGATION: "not no never neither nor nobody nicht kein keine niemals pas jamais aucun aucune nunca tampoco ningún",
    REPORT: "said says told wrote writes called quoted claims claimed reported sagte schrieb nannte behauptet dit écrit déclare dijo escribió llamó",
}
SEED_WEIGHT = 2.0
MIN_ODDS = 1.5
_CLAUSE = re.compile(r"[.!?;:,\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_STEMS = range(3, 8)
_TARGETS = frozenset(SEEDS[TARGET].split())
#: A target so many words after a term is what it aims at; a term is violence where that holds in this share of at least so many toxic texts.
_AIM, AIMED, LEAST_AIMED = 3, 0.8, 10
_ROOM = 200_000


@dataclass
class Transducer:
    """``moves``: (state, symbol) to (state, symbol written, factor); what it lacks is copied in the same state."""

    start: int
    moves: dict[tuple[int, int], tuple[int, int, float]] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.moves.get((state, symbol), (state, symbol, 1.0))


def insult(reach: int = 2, heaped: float = 1.1) -> Transducer:
    """Abuse becomes an insult; within ``reach`` words of another one it weighs more."""
    t = Transducer(0)
    for s in range(reach + 1):
        for symbol in range(8):
            t.moves[s, symbol] = (reach, INSULT, heaped if s else 1.0) if symbol == ABUSE else (max(0, s - 1), symbol, 1.0)
    return t


def threat() -> Transducer:
    """Violence waits (state 1) for a target, which then completes a threat."""
    return Transducer(0, {(0, VIOLENCE): (1, OTHER, 1.0), (1, VIOLENCE): (1, OTHER, 1.0), (1, TARGET): (0, THREAT, 1.0)})


def target(factor: float = 1.25) -> Transducer:
    """Insults after a target (state 1) weigh more."""
    return Transducer(0, {(0, TARGET): (1, OTHER, 1.0), (1, TARGET): (1, OTHER, 1.0), (0, THREAT): (1, THREAT, 1.0), (1, INSULT): (1, INSULT, factor)})


def negation(reach: int = 3, factor: float = 0.5) -> Transducer:
    """A mark within ``reach`` words of a negation weighs less."""
    t = Transducer(0)
    for s in range(reach + 1):
        t.moves[s, NEGATION] = (reach, OTHER, 1.0)
        for symbol in (OTHER, TARGET, REPORT):
            t.moves[s, symbol] = (max(0, s - 1), symbol, 1.0)
        for symbol in (INSULT, THREAT):
            t.moves[s, symbol] = (max(0, s - 1), symbol, factor if s else 1.0)
    return t


def reported(factor: float = 0.7) -> Transducer:
    """After a word of reporting (state 1) marks weigh less."""
    return Transducer(0, {(0, REPORT): (1, OTHER, 1.0), (1, REPORT): (1, OTHER, 1.0), (1, INSULT): (1, INSULT, factor), (1, THREAT): (1, THREAT, factor)})


def compose(*parts: Transducer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One table for the cascade: next state, symbol written and factor by state and symbol; state 0 is the start."""
    states, todo = {tuple(p.start for p in parts): 0}, [tuple(p.start for p in parts)]
    rows = []
    for at in todo:
        row = []
        for symbol in range(8):
            to, out, w = [], symbol, 1.0
            for p, s in zip(parts, at, strict=True):
                s2, out, f = p.step(s, out)
                to.append(s2)
                w *= f
            if tuple(to) not in states:
                states[tuple(to)] = len(states)
                todo.append(tuple(to))
            row.append((states[tuple(to)], out, w))
        rows.append(row)
    return tuple(np.array([[c[k] for c in r] for r in rows]).tolist() for k in range(3))


def cascade() -> tuple[list, list, list]:
    return compose(insult(), threat(), target(), negation(), reported())


@dataclass
class Model:
    words: dict[str, tuple[int, float]]
    stems: dict[str, float]
    curve: list[float]  # for the features, the last is the constant


class Grammar:
    """Clause scores of texts under a model."""

    def __init__(self, model: Model):
        self.m = model
        self.next, self.out, self.factor = cascade()
        self.seen: dict[str, tuple[int, float] | None] = {}

    def symbol(self, word: str) -> tuple[int, float] | None:
        got = self.m.words.get(word)
        if got is None or got[0] not in (ABUSE, VIOLENCE):
            w = max((self.m.stems.get(word[:k], 0.0) for k in _STEMS if len(word) >= k), default=0.0)
            got = (ABUSE, w) if w else got
        if len(self.seen) >= _ROOM:
            self.seen.clear()
        self.seen[word] = got
        return got

    def clauses(self, text: str | None) -> Iterator[tuple[int, float]]:
        """(place, score) of each clause; those without abuse or violence score zero unread."""
        seen, symbol = self.seen, self.symbol
        for k, clause in enumerate(_CLAUSE.split(text.lower()) if text else ()):
            symbols = [seen[w] if w in seen else symbol(w) for w in _WORD.findall(clause)]
            if not any(s is not None and s[0] in (ABUSE, VIOLENCE) for s in symbols):
                yield k, 0.0
                continue
            state, score, held = 0, 0.0, 0.0
            for s in symbols:
                c, w = s or (OTHER, 0.0)
                out, f = self.out[state][c], self.factor[state][c]
                state = self.next[state][c]
                if c == VIOLENCE:
                    held = max(held, w)
                if out == INSULT:
                    score = max(score, w * f)
                elif out == THREAT:
                    score, held = max(score, held * f), 0.0
            yield k, score

    def features(self, text: str | None) -> list[float]:
        scores = [s for _, s in self.clauses(text)]
        hits = [s for s in scores if s]
        return [max(hits, default=0.0), float(np.log1p(sum(hits))), 10 * len(hits) / (len(scores) + 10)]

    def score(self, text: str | None) -> float:
        x = np.array([*self.features(text), 1.0])
        return float(1 / (1 + np.exp(-np.clip(x @ np.array(self.m.curve), -30, 30))))


def _terms(text: str) -> dict[str, bool]:
    """Words, each with whether a target follows it closely in a clause, and word beginnings with a star."""
    out: dict[str, bool] = {}
    for clause in _CLAUSE.split(text.lower()):
        words = _WORD.findall(clause)
        near = len(words) + _AIM
        for i in range(len(words) - 1, -1, -1):
            w = words[i]
            out[w] = out.get(w, False) or near - i <= _AIM
            if w in _TARGETS:
                near = i
    return out | {w[:k] + "*": False for w in list(out) for k in _STEMS if len(w) >= k}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Weights by Newton steps, the last for the constant; scales are those of ``x``."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    keep = np.eye(len(w)) * ridge
    keep[-1, -1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Model:
    """Learns from the texts of ``docs`` that ``labels`` (doc_id, toxic) names."""
    labels = labels.filter("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    labels = bounded_sample(labels, sample_rows)
    # The sample is written, so the planner knows its size and broadcasts it where that is small.
    labels = written(labels, "toxic-labels")
    known = written(docs.select("doc_id", "text").filter("text is not null").join(labels, "doc_id").select("text", "toxic"), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(lo, 128) for lo in range(0, whole.num_rows, 128)):  # so that a table of terms stays small
                found: Counter = Counter()
                for text, toxic, apart in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    for t, aimed in _terms(text.as_py()).items():
                        found[t, toxic, apart, aimed] += 1
                keys = list(found)
                columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.bool_(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([found[k] for k in keys], pa.int64())], names=["term", "toxic", "apart", "aimed", "n"])

    # The curve must not be fitted where the lexicon was learned, so it gets one third and a lexicon of the other two.
    known = known.withColumn("apart", F.pmod(F.xxhash64("text"), F.lit(3)) == 0)
    counts = known.select("text", "toxic", "apart").mapInArrow(count, "term string, toxic int, apart boolean, aimed boolean, n long").groupBy("term").agg(
        *(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(a) for a, c in {"t": F.col("toxic") == 1, "c": F.col("toxic") != 1, "ta": (F.col("toxic") == 1) & ~F.col("apart"), "ca": (F.col("toxic") != 1) & ~F.col("apart"), "aimed": (F.col("toxic") == 1) & F.col("aimed")}.items())
    )
    counts = written(counts.filter("t >= 3"), "toxic-terms")
    n = {(r.toxic == 1, r.apart): r.n for r in known.groupBy("toxic", "apart").agg(F.count("*").alias("n")).collect()}
    of = lambda toxic, *parts: sum(v for (t, a), v in n.items() if t == toxic and a in parts)
    full = _lexicon(counts, "t", "c", of(True, True, False), of(False, True, False))
    if of(True, True) and of(False, True):
        part = _lexicon(counts, "ta", "ca", of(True, False), of(False, False))
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = Grammar(shared.value)
            for b in batches:
                x = [g.features(t.as_py()) for t in b.column(0)]
                yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in x], pa.float64()) for k in range(3)), b.column(1)], names=["a", "b", "c", "toxic"])

        got = known.filter("apart").select("text", "toxic").mapInArrow(features, "a double, b double, c double, toxic int").collect()
        full.curve = logistic(np.array([r[:3] for r in got]), np.array([float(r[3] == 1) for r in got]))
    return full


def _lexicon(counts: DataFrame, t: str, c: str, pos: int, neg: int) -> Model:
    """Terms whose log odds, less 1.5 standard errors, speak for toxicity. A term stands in three toxic texts of the sample, so they are bounded."""
    t, c = F.col(t), F.col(c)
    odds = F.log((t + 0.5) / (pos + 1)) - F.log((c + 0.5) / (neg + 1))
    sure = odds - 1.5 * F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    telling = counts.withColumn("w", sure).filter((t >= 3) & (F.col("w") >= MIN_ODDS)).select("term", "w", ((F.col("t") >= LEAST_AIMED) & (F.col("aimed") >= AIMED * F.col("t"))).alias("violent")).collect()
    words = {w: (symbol, SEED_WEIGHT) for symbol, ws in SEEDS.items() for w in ws.split()}
    stems = {}
    for r in telling:
        if r.term.endswith("*"):
            stems[r.term[:-1]] = float(r.w)
        elif r.term not in words or words[r.term][0] in (ABUSE, VIOLENCE):
            words[r.term] = (VIOLENCE if r.violent else ABUSE, float(r.w))
    # what a beginning says of a violent word would count it without a target
    violent = [w for w, (symbol, _) in words.items() if symbol == VIOLENCE]
    stems = {k: v for k, v in stems.items() if not any(w.startswith(k) for w in violent)}
    return Model(words, stems, [1.0, 1.0, 1.0, -4.0])


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_clauses (matched) and top_clause (place of the heaviest, -1 for none)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(shared.value)
        curve = np.array(shared.value.curve)
        for b in batches:
            feats, n, top = [], [], []
            for t in b.column("text"):
                scores = list(g.clauses(t.as_py()))
                hits = [(s, -k) for k, s in scores if s]
                feats.append([max(hits)[0] if hits else 0.0, float(np.log1p(sum(s for s, _ in hits))), 10 * len(hits) / (len(scores) + 10), 1.0])
                n.append(len(hits))
                top.append(-max(hits)[1] if hits else -1)
            p = 1 / (1 + np.exp(-np.clip(np.array(feats).reshape(-1, 4) @ curve, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64()), pa.array(n, pa.int32()), pa.array(top, pa.int32())], names=["doc_id", "score", "n_clauses", "top_clause"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, n_clauses int, top_clause int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs.filter(~held_out()), labels.filter(~held_out()))
    return toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses", "top_clause")
