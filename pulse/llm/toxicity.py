"""Operator 7, toxicity: a weighted finite-state pattern grammar over clauses.

A text is cut into clauses.  A weighted lexical transducer rewrites the words of a clause
that holds an insult or a threat to symbols; three further transducers rewrite
those in turn: negation (``not an idiot``), reported speech (``he said: ...``)
and target (``you ...``).  They are composed into one machine whose
states are tuples, built as they are met; a last one runs over its output from the end, for
targets that come after (``idiots like you``; a threat is only aimed at whom it names afterwards).
A match has all marks that it got: aimed at someone it counts several times what the bare word
does, negated or reported nearly nothing, and marks multiply.  Weights are summed per
matched clause; numbers of matches and terms count only what is neither negated nor reported.  A
logistic model over these gives the score; words outside the grammar add nothing.

Weights: FIXED terms start with a prior.  Labelled rows (``SAMPLE_ROWS`` of them
at most, chosen by hash; never held-out rows) teach further terms, whole words or
stems, and reweight all terms by smoothed log-odds; the model is fitted on the same
rows.  Near copies among them are thinned first, so that one copied text can't
pass for many.  All texts are scored whole.

Null and empty texts get the score of a text without matches.  Without any
labels, or with labels of one kind only, the priors and a fixed model are used.  An id with
different labels teaches nothing.  Ties, repeated rows and further columns do not matter: a score depends on the text alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.llm.common import read_table

SAMPLE_ROWS = 20_000           # labelled rows that the classifier is fitted on, at most (expected)
MIN_SUPPORT = 5                # toxic texts that a learned term must occur in
MIN_LOG_ODDS = 3.0
STEMS = (4, 5, 6)              # lengths of learned stems
NEAR_WORDS, NEAR_HASHES = 3, 6  # near copies among labelled rows: words of a shingle, hashes whose minima agree
HELD_OUT = 5                   # rows whose crc32(id) is divisible by this are never learned from
THRESHOLD = 0.5

# Terms of the grammar, by class.
INSULTS = (
    "arschloch bastard bastardo bitch blödmann cabrón capullo clown connard crétin cretin degenerate depp "
    "disgusting dumbass dummkopf dumpfbacke escoria estúpido filth freak gilipollas hurensohn idiot idiota "
    "idioten imbecile imbécil imbécile jerk loser maldito maggot missgeburt moron ordure pathetic pendejo "
    "pig-headed pouffiasse salaud salope schlampe schwachkopf scum scumbag stupid subhuman trash trottel "
    "vermin vollidiot wichser worthless").split()
THREATS = "kill murder strangle stab lynch slaughter umbringen erwürgen égorger étrangler matarte degollar".split()
TARGETS = "you your you're youre yourself u he she they them toi vous tu ton du dich dir euch ihr usted ustedes".split()
NEGATIONS = "not no never nobody isn't aren't wasn't n't nicht kein keine nie pas jamais ningún nunca".split()
REPORTS = ("said says saying called calls quoted wrote claimed according alleged reportedly sagte nannte schrieb "
           "zitiert dit déclaré écrit appelé dijo llamó escribió citado").split()
PRIOR = 2.0
BARE = {"I": 0.4, "T": 0.1}                    # part of a term's weight that counts without any mark
MARKS = {"I+you": 4.0, "T+you": 15.0, "I+not": 0.1, "T+not": 0.1, "I+said": 0.1, "T+said": 0.1}      # and by how much marks change it

_CLAUSE = re.compile(r"[^.!?;\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_UNIT = re.compile(r"[^\W\d_]+")

# Negation holds for this many words, a target for this many around a match.
NEGATION_SPAN, TARGET_SPAN = 3, 4


def negation(state: int, symbol: str) -> tuple[int, str]:
    """Marks what follows a negation closely."""
    if symbol == "N":
        return NEGATION_SPAN, "w"
    if symbol in ("I", "T"):
        return max(0, state - 1), symbol + "+not" if state else symbol
    return max(0, state - 1), symbol


def reported(state: int, symbol: str) -> tuple[int, str]:
    """Marks the matches after a verb of saying, to the end of the clause."""
    if symbol == "R":
        return 1, "w"
    return state, symbol + "+said" if state and symbol in ("I", "T") else symbol


def target(state: int, symbol: str) -> tuple[int, str]:
    """Marks insults aimed at someone named shortly before."""
    if symbol == "Y":
        return TARGET_SPAN, symbol
    left = max(0, state - 1)
    return left, symbol + "+you" if state and symbol[0] == "I" else symbol


def target_after(state: int, symbol: str) -> tuple[int, str]:
    """Read from the end: marks insults and threats aimed at someone named shortly after."""
    if symbol == "Y":
        return TARGET_SPAN, "w"
    left = max(0, state - 1)
    return left, symbol + "+you" if state and symbol[0] in "IT" and not symbol.endswith("+you") else symbol


def factor(symbol: str) -> float:
    """What a match counts of its term's weight, by all its marks."""
    base, *marks = symbol.split("+")
    return math.prod((MARKS[f"{base}+{m}"] for m in marks), start=BARE[base])


class Composed:
    """Composition of transducers: each rewrites the output of the one before; states are tuples, built lazily."""

    def __init__(self, *machines):
        self.machines, self.start, self.arcs = machines, (0,) * len(machines), {}

    def step(self, state: tuple, symbol: str) -> tuple[tuple, str]:
        arc = self.arcs.get((state, symbol))
        if arc is None:
            out, new = symbol, []
            for machine, s in zip(self.machines, state, strict=True):
                s, out = machine(s, out)
                new.append(s)
            arc = self.arcs[state, symbol] = (tuple(new), out)
        return arc


@dataclass
class Grammar:
    """Terms with weights (whole words, or stems that any word may go on from) and the model over clause scores."""

    words: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, PRIOR))
    model: tuple[float, ...] = (-3.0, 0.6, 0.6, 1.5, 0.2)

    def __post_init__(self):
        self.context = {**dict.fromkeys(TARGETS, "Y"), **dict.fromkeys(NEGATIONS, "N"), **dict.fromkeys(REPORTS, "R")}
        self.machine, self.back = Composed(negation, reported, target), Composed(target_after)
        self._anchors = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_anchors", "machine", "back")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.machine, self.back, self._anchors = Composed(negation, reported, target), Composed(target_after), None

    def anchors(self):
        """The lexical automaton that finds the clauses worth parsing."""
        if self._anchors is None:
            self._anchors = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for term in {**self.words, **self.stems, **self.threats}:
                self._anchors.add_word(term)
            self._anchors.make_automaton()
        return self._anchors

    def lexical(self, word: str) -> tuple[str, float, str]:
        """Symbol, weight and term of a word."""
        if word in self.words:
            return "I", self.words[word], word
        if word in self.threats:
            return "T", self.threats[word], word
        for n in STEMS:
            if (w := self.stems.get(word[:n])) is not None:
                return "I", w, word[:n]
        return self.context.get(word, "w"), 0.0, ""

    def parse(self, clause: str) -> list[tuple[str, float, str]]:
        """The matches of a clause: symbol with its marks, weight and term."""
        state, tape = self.machine.start, []
        for m in _WORD.finditer(clause):
            symbol, weight, term = self.lexical(m[0])
            state, out = self.machine.step(state, symbol)
            tape.append((out, weight, term))
        state, found = self.back.start, []
        for symbol, weight, term in reversed(tape):
            state, out = self.back.step(state, symbol)
            if out[0] in "IT":
                found.append((out, weight, term))
        return found[::-1]

    def features(self, text: str | None) -> list[float]:
        """Sum and maximum of the clause scores, number of matches (a bare one in part) and of terms, each dampened."""
        low = (text or "").lower()
        hits = [(end - n + 1, end + 1) for end, n in self.anchors().iter(low)] if len(self.anchors()) else []
        # an anchor counts where a word begins
        starts = sorted({s for s, _ in hits if not (s and low[s - 1].isalpha())})
        if not starts:
            return [0.0] * 4
        total = best = matches = 0.0
        terms: set[str] = set()
        i = 0
        for m in _CLAUSE.finditer(low):
            if i == len(starts):
                break
            if starts[i] >= m.end():
                continue
            while i < len(starts) and starts[i] < m.end():
                i += 1
            found = self.parse(m[0])
            score = sum(weight * factor(symbol) for symbol, weight, _ in found)
            total, best = total + score, max(best, score)
            for symbol, _, term in found:
                if "+not" not in symbol and "+said" not in symbol:
                    matches += min(1.0, factor(symbol))
                    terms.add(term)
        return [math.log1p(total), math.log1p(best), math.log1p(matches), math.log1p(len(terms))]

    def score(self, features) -> float:
        z = self.model[0] + sum(w * x for w, x in zip(self.model[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def default_grammar() -> Grammar:
    return Grammar(dict.fromkeys(INSULTS, PRIOR))


def _units(text: str) -> set[tuple[str, bool]]:
    words = set(_UNIT.findall(text.lower()))
    return {(w, False) for w in words if len(w) > 2} | {(w[:n], True) for w in words for n in STEMS if len(w) > n}


def _unit_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial numbers of toxic and other texts by term, flushed before they grow large."""
    counts = {0: Counter(), 1: Counter()}

    def flush():
        keys = list(counts[0].keys() | counts[1].keys())
        out = pd.DataFrame({"unit": [k[0] for k in keys], "stem": [k[1] for k in keys],
                            "pos": [counts[1][k] for k in keys], "neg": [counts[0][k] for k in keys]})
        counts[0].clear()
        counts[1].clear()
        return out

    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
            counts[int(toxic)].update(_units(text or ""))
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield flush()
    yield flush()


def _select_terms(rows, n_pos: int, n_neg: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems to learn: a stem only where several words share it, a word only where no chosen stem has it."""
    odds = {(r.unit, r.stem): math.log((r.pos + 0.5) / (n_pos + 1)) - math.log((r.neg + 0.5) / (n_neg + 1)) for r in rows}
    pos = {(r.unit, r.stem): r.pos for r in rows}
    alone: Counter = Counter()
    for (unit, stem), n in pos.items():
        if not stem:
            for k in STEMS:
                alone[unit[:k]] = max(alone[unit[:k]], n)
    stems: dict[str, float] = {}
    for unit, stem in sorted((u for u in odds if u[1]), key=lambda u: (len(u[0]), u[0])):
        spread = alone[unit] < 0.7 * pos[unit, stem]
        if odds[unit, stem] >= MIN_LOG_ODDS and spread and not any(unit[:k] in stems for k in STEMS if k < len(unit)):
            stems[unit] = min(6.0, odds[unit, stem])
    words = {u: min(6.0, odds[u, s]) for u, s in odds
             if not s and odds[u, s] >= MIN_LOG_ODDS and not any(u[:k] in stems for k in STEMS)}
    return words, stems


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (p - y) + ridge * np.r_[0, beta[1:]]
        hess = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, toxic of at most about ``sample_rows`` labelled rows outside the held-out part, near copies thinned.

    Texts whose shingles of ``NEAR_WORDS`` words have equal minima under ``NEAR_HASHES`` independent hashes count as near copies:
    copies always do, texts that share a tenth of their shingles one time in a million.
    """
    usable = (labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
              .filter(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
              .groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_other")).filter(F.col("toxic") == F.col("_other")).drop("_other"))
    total = usable.count()
    if total > sample_rows:
        usable = usable.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / total))
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.join(usable, "id")
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - (NEAR_WORDS - 1), F.lit(1)))
    shingles = F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, NEAR_WORDS)))

    def least(k: int) -> Column:
        return F.array_min(F.transform("_shingles", lambda h: F.xxhash64(F.lit(k), h)))

    minima = F.array(*map(least, range(NEAR_HASHES)))
    hashed = joined.withColumn("_words", F.split(F.lower(F.trim("text")), r"\s+")).withColumn("_shingles", shingles)
    return hashed.withColumn("_near", minima).groupBy("_near", "toxic").agg(
        F.min_by("text", F.struct("id", "text")).alias("text")).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Grammar:
    """Learn terms, weights and model from the sampled labelled rows; only bounded counts and features reach the driver."""
    sample = training_rows(docs, labels, sample_rows).persist()
    try:
        sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
        if not n_pos or not n_neg:
            return default_grammar()
        counts = (sample.mapInPandas(_unit_counts, "unit string, stem boolean, pos long, neg long")
                  .groupBy("unit", "stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
        lift = (F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1)))
        learned = counts.filter((F.col("pos") >= MIN_SUPPORT) & (lift >= MIN_LOG_ODDS)).collect()        # terms of the sampled texts
        words, stems = _select_terms(learned, n_pos, n_neg)
        fixed = {r.unit: math.log((r.pos + 0.5) / (n_pos + 1)) - math.log((r.neg + 0.5) / (n_neg + 1))
                 for r in counts.filter(~F.col("stem") & F.col("unit").isin(INSULTS + THREATS)).collect()
                 if r.neg >= MIN_SUPPORT or r.pos >= MIN_SUPPORT}
        prior, threats = ({w: max(0.0, min(6.0, fixed.get(w, PRIOR))) for w in terms} for terms in (INSULTS, THREATS))
        grammar = Grammar({w: v for w, v in {**prior, **words}.items() if v > 0 and w not in threats}, stems, threats)
        fields = sample.select(feature_udf(grammar)(F.col("text")).alias("x"), "toxic").toPandas()
        fields = fields.sort_values("toxic", kind="stable")
        grammar.model = _fit_logistic(np.array(fields["x"].tolist(), float), fields["toxic"].to_numpy(float))
        return grammar
    finally:
        sample.unpersist()


def feature_udf(grammar: Grammar):
    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([grammar.features(t) for t in texts])
    return features


def score_udf(grammar: Grammar):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([grammar.score(grammar.features(t)) for t in texts], dtype="float64")
    return score


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = read_table(spark, sf_dir, "documents")
    grammar = learn(docs, read_table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                         score_udf(grammar)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents scored below the threshold, unchanged."""
    grammar = learn(docs, read_table(spark, sf_dir, "labels"))
    return docs.filter(score_udf(grammar)(F.col("text")) < THRESHOLD)
