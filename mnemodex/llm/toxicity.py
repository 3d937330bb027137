"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon reads a clause's words, longest phrase first, and writes symbols: insult, threat, target, negation, speech verb,
first person, contrast, other. Five small transducers read them one after another:

- negation marks the insults and threats within its reach, which a contrast ends;
- reported speech marks those after a speech verb, unless the first person is the speaker;
- threat joins a verb and a target near it, on either side, to a threat against someone;
- target marks insults after a target, and writes what a target after an insult adds;
- insult weighs what is left: each symbol's learned strength, times what its marks leave of it.

All five are tables of arcs (state, symbol, next state, symbol, weight) with one arc for a state and symbol, and so is their composition, the one automaton that
reads a clause from left to right. A text's score comes from its matched clauses, never from words as such. The strengths are learned: the log-odds of the documents that
hold a word.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemodex.llm.common import bounded_share, cut, fresh

#: At most about so many labelled documents are learned from; an arc is learned for words in so many of them,
#: whose log-odds are this high even two standard errors lower. No more than ``MOST_ARCS`` arcs are kept.
MOST_ROWS, LEAST_DOCS, LEAST_WEIGHT, MOST_ARCS = 24_000, 4, 1.0, 20_000
#: The strengths of insults and threats.
STRENGTHS = (1.5, 3.0, 5.0, 7.0)
#: What a target in the clause, a negation before and a report around it do to a strength, and what a threat without a target has of it.
WITH_TARGET, NEGATED, REPORTED, AIMLESS = 1.25, 0.35, 0.6, 0.5
#: Words that a negation reaches, and that may stand between a threat and its target or a first person and its verb.
REACH, NEAR = 4, 3

TARGETS = {"you", "your", "he", "she", "they", "him", "her", "them", "people", "du", "dich", "ihr", "sie", "er", "tu", "vous", "il", "elle", "ils", "elles", "usted", "ustedes", "él", "ella", "ellos", "ellas"}
NEGATIONS = {"not", "no", "never", "neither", "nor", "without", "isn't", "aren't", "don't", "nicht", "kein", "keine", "nie", "niemals", "pas", "jamais", "aucun", "aucune", "sans", "nunca", "jamás", "ningún", "ninguna", "sin"}
REPORTS = {"said", "says", "say", "told", "wrote", "claimed", "quoted", "called", "reported", "sagte", "sagt", "schrieb", "nannte", "dit", "déclaré", "écrit", "appelé", "dijo", "dice", "escribió", "llamó"}
THREATS = {"kill", "hurt", "destroy", "beat", "töten", "schlagen", "tuer", "frapper", "matar", "golpear", "beat up", "cut down", "get rid of"}
FIRST = {"i", "we", "ich", "wir", "je", "nous", "yo", "nosotros"}
CONTRASTS = {"but", "aber", "sondern", "mais", "pero", "sino"}

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
FEATURES = 4

#: (kind, strength, marks). Kinds: other, target, negation, speech, first, contrast, insult, threat; between transducers also aimed (a threat
#: that has met its target) and met (an insult that a target follows). Marks: negated, reported, targeted.
Symbol = tuple[str, int, str]
WORD_SYMBOLS: list[Symbol] = [(k, 0, "") for k in ("other", "target", "negation", "speech", "first", "contrast")] + [(k, s, "") for k in ("insult", "threat") for s in range(len(STRENGTHS))]
_OTHER: Symbol = ("other", 0, "")


@dataclass
class Transducer:
    #: (state, symbol) -> (next state, symbol, weight); state 0 is where a clause begins.
    arcs: dict[tuple[int, Symbol], tuple[int, Symbol, float]]

    def symbols(self) -> set[Symbol]:
        return {a[1] for a in self.arcs.values()}

    def run(self, clause: Iterable[Symbol]) -> tuple[list[Symbol], float]:
        state, out, total = 0, [], 0.0
        for symbol in clause:
            state, written, weight = self.arcs[state, symbol]
            out.append(written)
            total += weight
        return out, total


def tabulate(step: Callable[[Hashable, Symbol], tuple[Hashable, Symbol, float]], start: Hashable, alphabet: Iterable[Symbol]) -> Transducer:
    """The arcs of all states that ``step`` reaches from ``start``."""
    alphabet, number, todo, arcs = list(alphabet), {start: 0}, [start], {}
    while todo:
        state = todo.pop()
        for symbol in alphabet:
            after, written, weight = step(state, symbol)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            arcs[number[state], symbol] = number[after], written, weight
    return Transducer(arcs)


def compose(one: Transducer, two: Transducer) -> Transducer:
    """The transducer that has two read what one writes; its weights are the sums of theirs."""

    def step(states, symbol):
        a, written, w = one.arcs[states[0], symbol]
        b, written, v = two.arcs[states[1], written]
        return (a, b), written, w + v

    return tabulate(step, (0, 0), {symbol for _, symbol in one.arcs})


def _marked(symbol: Symbol, mark: str) -> Symbol:
    return symbol[0], symbol[1], symbol[2] + mark


def _negation(left, symbol):
    kind = symbol[0]
    if kind == "negation":
        return REACH, symbol, 0.0
    if kind == "contrast":
        return 0, symbol, 0.0
    return max(0, left - 1), _marked(symbol, "-") if left and kind in ("insult", "threat") else symbol, 0.0


def _reported(state, symbol):
    kind = symbol[0]
    if state == "reported":
        return state, _marked(symbol, "\"") if kind in ("insult", "threat") else symbol, 0.0
    if kind == "first":
        return NEAR, symbol, 0.0
    if kind == "speech":
        return 0 if state else "reported", symbol, 0.0
    return max(0, state - 1), symbol, 0.0


def _threat(state, symbol):
    """States: None, a target was met so many words ago, or a threat waits for one."""
    kind = symbol[0]
    if kind == "threat":
        if isinstance(state, int):
            return None, ("aimed", *symbol[1:]), 0.0
        return (NEAR, symbol), symbol, 0.0
    if kind == "target":
        if isinstance(state, tuple):
            return NEAR, ("aimed", state[1][1], state[1][2] + "+"), 0.0  # a part of its strength is counted already
        return NEAR, symbol, 0.0
    if isinstance(state, tuple):
        return (state[0] - 1, state[1]) if state[0] > 1 else None, symbol, 0.0
    return state - 1 if state and state > 1 else None, symbol, 0.0


def _target(state, symbol):
    """States: None, a target was met, or the insult that waits for one."""
    kind = symbol[0]
    if kind == "insult":
        return ("met", _marked(symbol, "@"), 0.0) if state == "met" else (symbol, symbol, 0.0)
    if kind == "target":
        return "met", ("met", *state[1:]) if isinstance(state, tuple) else symbol, 0.0
    return "met" if kind == "aimed" else state, symbol, 0.0


def _insult(state, symbol):
    kind, strength, marks = symbol
    if kind not in ("insult", "threat", "aimed", "met"):
        return state, _OTHER, 0.0
    weight = STRENGTHS[strength] * (NEGATED if "-" in marks else 1.0) * (REPORTED if "\"" in marks else 1.0)
    weight *= {"insult": WITH_TARGET if "@" in marks else 1.0, "met": WITH_TARGET - 1, "threat": AIMLESS, "aimed": WITH_TARGET - (AIMLESS if "+" in marks else 0)}[kind]
    return state, _OTHER, weight


def transducers() -> list[Transducer]:
    """The five of them, in the order in which they read."""
    out, alphabet = [], WORD_SYMBOLS
    for step, start in ((_negation, 0), (_reported, 0), (_threat, None), (_target, None), (_insult, 0)):
        out.append(tabulate(step, start, alphabet))
        alphabet = out[-1].symbols()
    return out


@cache
def automaton() -> tuple[list[list[int]], list[list[float]]]:
    """Next state and weight by state and number of the word's symbol in ``WORD_SYMBOLS``."""
    whole = None
    for one in transducers():
        whole = one if whole is None else compose(whole, one)
    states = 1 + max(state for state, _ in whole.arcs)
    rows = [[whole.arcs[s, symbol] for symbol in WORD_SYMBOLS] for s in range(states)]
    return [[a[0] for a in row] for row in rows], [[a[2] for a in row] for row in rows]


@dataclass
class Grammar:
    #: phrase, its words parted by spaces -> number of its symbol; and for each first word the lengths of its phrases, longest first.
    lexicon: dict[str, int]
    lengths: dict[str, list[int]]
    #: First words of the phrases that have a weight.
    weighed: frozenset[str]
    #: Weights of the features of a text, and the bias.
    weights: np.ndarray

    @classmethod
    def of(cls, strengths: dict[str, float], weights: np.ndarray) -> Grammar:
        """Phrases of ``THREATS`` are threats, all others of ``strengths`` insults, each of the nearest of ``STRENGTHS``; the lists of other kinds go before."""
        level = {phrase: min(range(len(STRENGTHS)), key=lambda i: abs(STRENGTHS[i] - w)) for phrase, w in ({p: 0.0 for p in THREATS} | strengths).items()}
        lexicon = {p: WORD_SYMBOLS.index(("threat" if p in THREATS else "insult", s, "")) for p, s in level.items()}
        for kind, phrases in (("first", FIRST), ("speech", REPORTS), ("target", TARGETS), ("negation", NEGATIONS), ("contrast", CONTRASTS)):
            lexicon |= {p: WORD_SYMBOLS.index((kind, 0, "")) for p in phrases}
        lengths: dict[str, set[int]] = {}
        for phrase in lexicon:
            lengths.setdefault(phrase.split()[0], set()).add(len(phrase.split()))
        weighed = frozenset(p.split()[0] for p, n in lexicon.items() if WORD_SYMBOLS[n][0] in ("insult", "threat"))
        return cls(lexicon, {w: sorted(n, reverse=True) for w, n in lengths.items()}, weighed, weights)

    def symbols(self, tokens: list[str]) -> list[int]:
        """The numbers of a clause's symbols; a phrase counts at its last word."""
        out, at = [0] * len(tokens), 0
        while at < len(tokens):
            for n in self.lengths.get(tokens[at], ()):
                number = self.lexicon.get(" ".join(tokens[at : at + n]))
                if number is not None and at + n <= len(tokens):
                    at += n - 1
                    out[at] = number
                    break
            at += 1
        return out


def tokens_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def clause_weight(tokens: list[str], grammar: Grammar) -> float:
    """What the composed automaton gathers from a clause."""
    after, weight = automaton()
    state, total = 0, 0.0
    for number in grammar.symbols(tokens):
        total += weight[state][number]
        state = after[state][number]
    return total


def evidence(text: str | None, grammar: Grammar) -> np.ndarray:
    """Of the matched clauses: strongest and summed weight, their number, and their weight for each word of the text."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    every = tokens_of(text)
    if grammar.weighed.isdisjoint(every):
        return out
    weights = []
    for clause in _CLAUSE.split(text.lower()):
        tokens = _WORD.findall(clause)
        if not grammar.weighed.isdisjoint(tokens):
            weight = clause_weight(tokens, grammar)
            if weight:
                weights.append(weight)
    if weights:
        out[:] = max(weights), np.log1p(sum(weights)), np.log1p(len(weights)), np.log1p(1000 * sum(weights) / (1 + len(every)))
    return out


def _probability(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a little ridge; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = _probability(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
        w += np.linalg.solve(hessian, x.T @ (y - p) - 0.5 * w)
    return w


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_ROWS) -> Grammar:
    """The grammar's arcs and the weights of its evidence, from the labelled rows for which ``learn`` holds.

    Spark counts in how many documents of either label each word occurs. The driver gets the arcs (at most
    ``MOST_ARCS``) and ``FEATURES`` numbers for each of about ``most`` labelled documents. Without toxic rows
    nothing is learned but the given threats, and every text scores low. Null ids and labels are passed over; of rows that share
    an id the largest label and the smallest text count.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    marked = bounded_share(marked.filter(learn), F.col("doc_id"), most).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(marked), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    rows = cut(rows.select("label", "text"))
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sum(n for y, n in sizes.items() if y != 1)
    if not toxic or not clean:
        return Grammar.of({}, np.array([0.0] * FEATURES + [-3.0]))

    def split(batches):
        for batch in batches:
            found = [(w, y == 1) for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()) for w in set(tokens_of(t))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.bool_())], names=["word", "toxic"])

    seen = rows.mapInArrow(split, "word string, toxic boolean").groupBy("word").agg(F.sum(F.col("toxic").cast("long")).alias("t"), F.sum((~F.col("toxic")).cast("long")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    strong = seen.filter(F.col("t") >= LEAST_DOCS).withColumn("w", odds).filter(F.col("w") - 2 * error >= LEAST_WEIGHT)
    listed = NEGATIONS | TARGETS | REPORTS | FIRST | CONTRASTS
    learned = {r[0]: float(r[1]) for r in strong.orderBy(F.desc("w"), "word").limit(MOST_ARCS).select("word", "w").collect() if r[0] not in listed}
    grammar = Grammar.of(learned, np.zeros(FEATURES + 1))

    def weigh(batches):
        for batch in batches:
            x = np.array([evidence(t, grammar) for t in batch.column("text").to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array(c) for c in x.T)], names=["label", *(f"x{i}" for i in range(FEATURES))])

    found = rows.mapInArrow(weigh, "label int, " + ", ".join(f"x{i} double" for i in range(FEATURES))).toPandas()
    grammar.weights = _logistic(found.iloc[:, 1:].to_numpy(), (found["label"] == 1).to_numpy(float))
    return grammar


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (its id by default) and ``score`` (0 to 1): one row for each row, over its whole text.

    Null and empty texts, and those without a matched clause, get the bias alone. Repeated rows and null ids are scored like any other.
    A column ``score`` in ``keep`` is replaced.
    """
    keep = [c for c in ([id_col] if keep is None else keep) if c != "score"]
    name = fresh("text", [*keep, "score"])
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(name))
    schema = rows.select(*keep).withColumn("score", F.lit(0.0)).schema
    held = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches):
        g = held.value
        for batch in batches:
            x = np.array([evidence(t.as_py(), g) for t in batch.column(name)]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(_probability(x @ g.weights[:-1] + g.weights[-1]))], names=[*keep, "score"])

    return rows.mapInArrow(run, schema)
