"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read the words of a clause as symbols: negation, reported speech, target, insult
and threat. Each passes symbols on, adds weights and may rewrite a symbol; composed, they are one
deterministic machine that weighs every insult or threat by what stands around it in its clause (aimed at
someone, negated, quoted or reported). A document's score is a logistic function of its matched clauses,
never of words outside them.

The words that the insult transducer accepts are a fixed seed list and terms learned from labels: words
and word stems that are frequent in toxic documents and rare in others, chosen greedily until those
documents are covered. Learning uses at most ``FIT_ROWS`` labelled documents of each label (those with the
smallest id hashes, held-out ids excluded); labels, lang, source and id are never inputs of a score.

Defined results: null text is empty and scores as a text without a match; labels that are null or whose
document is missing are not learned from; without labels the seed list and fixed coefficients are used;
repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import narrow, remainder, stored

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Labelled documents of each label to learn from; lengths of stems; share and number of the toxic
#: documents that a term must occur in; least log-odds, after ERRORS standard errors are taken off; the
#: weight up to which a toxic document is covered by more terms; most terms.
FIT_ROWS, STEMS, LEAST_SHARE, LEAST_DOCS, LEAST_ODDS, ERRORS, COVER, MOST_TERMS = 10_000, (4, 5, 6, 7, 8), 0.01, 3, 1.2, 1.3, 8.0, 400

FEATURES = ("heaviest", "weight", "density")

# Seed words of the grammar.
INSULTS = (
    "idiot idiots stupid moron morons dumb loser losers worthless pathetic scum trash garbage disgusting clown "
    "fool imbecile jerk bastard dimwit halfwit vermin parasite filth lowlife retard freak ugly liar coward"
).split()
THREATS = "kill hurt beat destroy punch stab shoot strangle smash burn hunt töten schlagen tuer frapper matar golpear".split()
FUTURE = "will ll shall gonna going werde wirst vais va voy".split()
TARGETS = (
    "you your yours yourself u he she they them him her these those people "
    "du dich dir dein ihr euch sie tu te toi ton vous votre eres usted ustedes"
).split()
NEGATIONS = "not never no neither nor isn aren wasn don doesn nicht nie kein keine pas jamais nunca ni".split()
REPORTS = (
    "said says say called calls calling claimed wrote tweeted replied reported alleged quoted accused "
    "sagte nannte dit disait appelle dijo llamó llama"
).split()

_WORD = re.compile(r"[^\W\d_]+|[\"“”„«»]")
#: A contracted negation is one word.
_SAID = re.compile(r"[^\W\d_]+n['’]t(?![^\W\d_])|[^\W\d_]+|[\"“”„«»]")
_CLAUSE = re.compile(r"[.!?;\n]")
#: Marks that open and close a quotation; one that is still open at the end of its line is given up.
_MARKS = re.compile(r"[\"“”„«»\n]")
_CLOSES = "”»"
OTHER, INSULT, THREAT, FUT, TARGET, NEGATION, REPORT, QUOTE, MATCH = "x", "I", "T", "F", "Y", "N", "R", "Q", "M"
SYMBOLS = (OTHER, INSULT, THREAT, FUT, TARGET, NEGATION, REPORT, QUOTE)
DENIED, TOLD = -2.5, -1.5
#: A verb of harm between the machines, by the penalty that it brings along to its target.
HELD = {THREAT: 0.0, "T denied": DENIED, "T told": TOLD, "T denied, told": DENIED + TOLD}


@dataclass
class Transducer:
    """A deterministic transducer: (state, symbol) to (state, output, weight); what has no arc stays in
    place and passes unchanged."""

    start: object = 0
    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def then(self, other: "Transducer", symbols=SYMBOLS) -> "Transducer":
        """The composition: what this machine puts out, the other reads."""
        arcs, todo, seen = {}, [(self.start, other.start)], set()
        while todo:
            state = todo.pop()
            if state in seen:
                continue
            seen.add(state)
            for s in symbols:
                a, out, w = self.step(state[0], s)
                b, out, v = other.step(state[1], out)
                arcs[state, s] = ((a, b), out, w + v)
                todo.append((a, b))
        return Transducer((self.start, other.start), arcs)

    def weights(self, symbols: list[str]) -> list[float]:
        """The context weight of every match in a run of symbols."""
        state, out = self.start, []
        for s in symbols:
            state, put, w = self.step(state, s)
            if put == MATCH:
                out.append(w)
            elif w and out:
                out[-1] += w
        return out


def negation() -> Transducer:
    """An insult or threat up to three words after a negation loses weight, a threat when it meets its target."""
    arcs = {(k, NEGATION): (1, NEGATION, 0.0) for k in range(4)}
    for k in (1, 2, 3):
        for s in (OTHER, TARGET, FUT, REPORT, QUOTE):
            arcs[k, s] = ((k + 1) % 4, s, 0.0)
        arcs[k, INSULT], arcs[k, THREAT] = (k, INSULT, DENIED), (k, "T denied", 0.0)
    return Transducer(0, arcs)


def reported() -> Transducer:
    """After a verb of saying, or inside quotation marks, what is said is not the author's."""
    arcs = {}
    for k in (0, 1, 2):
        arcs[k, REPORT] = (max(k, 1), REPORT, 0.0)
        arcs[k, QUOTE] = (0 if k == 2 else 2, QUOTE, 0.0)
        if k:
            arcs[k, INSULT] = (k, INSULT, TOLD)
            arcs[k, THREAT], arcs[k, "T denied"] = (k, "T told", 0.0), (k, "T denied, told", 0.0)
    return Transducer(0, arcs)


def target() -> Transducer:
    """An insult within six words after a target, or with one right behind it, gains weight."""
    arcs = {(k, TARGET): (1, TARGET, 0.0) for k in range(7)}
    for k in range(1, 7):
        arcs[k, OTHER] = (k + 1 if k < 6 else 0, OTHER, 0.0)
        arcs[k, INSULT] = (k, INSULT, 1.5)
    arcs[0, INSULT] = ("after", INSULT, 0.0)
    arcs["after", INSULT] = ("after", INSULT, 0.0)
    arcs["after", TARGET] = (1, TARGET, 0.75)
    arcs["after", OTHER] = (0, OTHER, 0.0)
    return Transducer(0, arcs)


def insult() -> Transducer:
    return Transducer(0, {(0, INSULT): (0, MATCH, 0.0)})


def threat() -> Transducer:
    """A verb of harm counts when a target follows; more so after a future form. Its penalty waits with it
    for the target; of several verbs before one target, the mildest penalty counts."""
    arcs = {(0, FUT): ("will", OTHER, 0.0)}
    for s in (TARGET, FUT):
        arcs["will", s] = ("will", OTHER, 0.0)
    arcs["will", OTHER] = ("near", OTHER, 0.0)
    arcs["near", OTHER] = (0, OTHER, 0.0)
    for verb, penalty in HELD.items():
        arcs["will", verb] = arcs["near", verb] = (("aimed", penalty), OTHER, 0.0)
        arcs[0, verb] = (("verb", penalty), OTHER, 0.0)
        for state, weight in (("aimed", 4.0), ("verb", 2.0)):
            own, later = (state, penalty), (f"{state} 2", penalty)
            arcs[own, TARGET] = (0, MATCH, weight + penalty)
            arcs[own, OTHER] = (later, OTHER, 0.0)
            arcs[later, TARGET] = (0, MATCH, weight - 1 + penalty)
            arcs[later, OTHER] = (0, OTHER, 0.0)
            for other, less in HELD.items():
                if less > penalty:
                    arcs[own, other], arcs[later, other] = ((state, less), other, 0.0), ((f"{state} 2", less), other, 0.0)
    return Transducer(0, arcs)


def grammar() -> Transducer:
    return negation().then(reported()).then(target()).then(threat()).then(insult())


class Scorer:
    """Finds the clauses with a match and weighs them. ``terms``: (text, is a stem, weight)."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.machine = grammar()
        self.stems = {t: w for t, stem, w in terms if stem}
        self.words = {t: w for t, stem, w in terms if not stem}
        self.symbol = {}
        for symbol, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (FUT, FUTURE), (THREAT, THREATS)):
            self.symbol.update(dict.fromkeys(words, symbol))
        self.symbol.update(dict.fromkeys('"“”„«»', QUOTE))
        self.find = ahocorasick.Automaton()
        for t in {*self.stems, *self.words, *THREATS}:
            self.find.add_word(t, t)
        self.find.make_automaton()

    def lexical(self, word: str) -> float:
        return max([self.words.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in STEMS)])

    def clauses(self, text: str) -> list[float]:
        """The weight of every clause with a match, in one walk over the text. A clause that begins inside a
        quotation is told like the one in which it was opened."""
        low, end, out = text.lower(), 0, []
        seen, quoted = 0, ""
        for last, term in self.find.iter(low):
            first = last - len(term) + 1
            if first < end or first and low[first - 1].isalpha():
                continue
            if term not in self.stems and low[last + 1 : last + 2].isalpha():
                continue
            begin = max(end, *(low.rfind(c, end, first) + 1 for c in ".!?;\n"))
            stop = _CLAUSE.search(low, last)
            end = stop.start() if stop else len(low)
            for m in _MARKS.finditer(low, seen, begin):
                mark = m.group()
                if mark == "\n" or quoted and (mark in _CLOSES or mark == quoted or (quoted, mark) == ("„", "“")):
                    quoted = ""
                elif not quoted and mark not in _CLOSES:
                    quoted = mark
            seen = begin
            symbols, lexical = [QUOTE] if quoted else [], []
            for word in _SAID.findall(low, begin, end):
                w = self.lexical(word)
                symbols.append(INSULT if w else NEGATION if word.endswith(("n't", "n’t")) else self.symbol.get(word, OTHER))
                if w:
                    lexical.append(w)
            found = self.machine.weights(symbols)
            if len(found) == len(lexical):
                found = [a + b for a, b in zip(found, lexical)]
            elif lexical:  # threats stand among the insults
                found = [a + max(lexical) for a in found]
            if found and max(found) > 0:
                out.append(max(found))
        return out

    def features(self, text: str) -> tuple[float, float, float]:
        """The heaviest clause, the clauses' sum, and the sum per hundred words, the last two damped."""
        found = self.clauses(text)
        if not found:
            return 0.0, 0.0, 0.0
        total = sum(found)
        return max(found), float(np.log1p(total)), float(np.log1p(100 * total / max(len(text.split()), 20)))


def terms_of(text: str) -> set[tuple[str, bool]]:
    """Words and stems of a text."""
    words = {w for w in _WORD.findall(text.lower()) if len(w) >= 4}
    return {(w, False) for w in words} | {(w[:k], True) for w in words for k in STEMS if len(w) > k}


def training_rows(docs: DataFrame, marks: DataFrame, label_col: str) -> DataFrame:
    """(label, text) of at most FIT_ROWS documents of each label; the ids are broadcast, texts stay put."""
    marks = marks.select(marks["doc_id"].alias("_id"), marks[label_col].cast("int").alias("label")).where("_id IS NOT NULL")
    marks = marks.where(remainder(F.col("_id"), FOLDS) != HELD_OUT)
    ids = [marks.where(F.col("label") == k).orderBy(F.xxhash64("_id"), "_id").limit(FIT_ROWS) for k in (0, 1)]
    few = F.broadcast(ids[0].unionByName(ids[1]))
    return stored(docs.join(few, F.col("doc_id") == F.col("_id")).select("label", "text"), "labelled-texts")


def count_terms(rows: DataFrame, wanted: set | None) -> dict[tuple[str, bool], int]:
    """Documents that each term occurs in, over whole texts: of the wanted terms, or of all that reach the
    least share (at most terms-of-a-text / share of them)."""
    total = rows.count()
    least = max(LEAST_DOCS, LEAST_SHARE * total) if wanted is None else 1

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                found = terms_of(t.as_py())
                counts.update(found if wanted is None else found & wanted)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([counts[k] for k in keys], pa.int64())],
            ["term", "stem", "n"],
        )

    parts = rows.select("text").mapInArrow(run, "term string, stem boolean, n bigint")
    found = parts.groupBy("term", "stem").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return {(r.term, r.stem): r.n for r in found.collect()}


def lexicon(rows: DataFrame) -> list[tuple[str, bool, float]]:
    """Seed words and learned terms with their weights."""
    toxic, clean = rows.where("label = 1"), rows.where("label = 0")
    n1, n0 = toxic.count(), clean.count()
    terms = {(w, False): 1.5 for w in INSULTS}
    in_toxic = count_terms(toxic, None) if n1 and n0 else {}
    if in_toxic:
        in_clean = count_terms(clean, set(in_toxic))
        odds, good = {}, {}
        for t, n in in_toxic.items():
            m = in_clean.get(t, 0)
            odds[t] = float(np.log((n + 0.5) / (n1 + 1)) - np.log((m + 0.5) / (n0 + 1)))
            if odds[t] - ERRORS * (1 / (n + 0.5) + 1 / (m + 0.5)) ** 0.5 >= LEAST_ODDS:
                good[t] = odds[t]

        def run(batches):
            for b in batches:
                found = [[f"{int(s)}{w}" for w, s in terms_of(t.as_py()) & set(good)] for t in b.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["terms"])

        held = [{(x[1:], x[0] == "1") for x in r.terms} for r in toxic.select("text").mapInArrow(run, "terms array<string>").collect()]
        for t, w in choose(held, good, n1).items():
            terms[t] = w
        for t in list(terms):  # seeds that the labels speak for or against
            if t in odds:
                terms[t] = max(odds[t], 0.1)
    return [(t, stem, w) for (t, stem), w in sorted(terms.items())]


def choose(held: list[set], good: dict, toxic: int) -> dict:
    """Terms, greedily by what they add to documents whose weight is still below ``COVER``."""
    where: dict[tuple[str, bool], list[int]] = {}
    for i, own in enumerate(held):
        for t in own:
            where.setdefault(t, []).append(i)
    weight, taken = np.zeros(len(held)), {}
    while where and len(taken) < MOST_TERMS:
        open_ = weight < COVER
        gains = {t: int(open_[docs].sum()) for t, docs in where.items()}
        best = max(gains, key=lambda t: (gains[t] * good[t], t))
        if gains[best] < max(LEAST_DOCS, LEAST_SHARE * toxic):
            break
        taken[best] = good[best]
        weight[where.pop(best)] += good[best]
    return taken


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Newton's method for a ridge logistic regression with a constant."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - ridge * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta = beta + np.linalg.solve(curve, slope)
    return beta


def matched(rows: DataFrame, terms: list[tuple[str, bool, float]], keep: str, kind: str) -> DataFrame:
    """``keep`` and the three features of every text."""

    def run(batches):
        scorer = Scorer(terms)
        for b in batches:
            x = np.array([scorer.features(t.as_py()) for t in b.column(1)], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x[:, k]) for k in range(3)]], [keep, *FEATURES])

    return rows.select(keep, "text").mapInArrow(run, f"{keep} {kind}, " + ", ".join(f"{f} double" for f in FEATURES))


def fit(docs: DataFrame, marks: DataFrame, label_col="toxic"):
    """(terms, coefficients) from narrowed documents and labels."""
    rows = training_rows(docs, marks, label_col)
    terms = lexicon(rows)
    made = np.array([(r.label, *[r[f] for f in FEATURES]) for r in matched(rows, terms, "label", "int").collect()], float).reshape(-1, 4)
    y = made[:, 0]
    if not (0 < y.sum() < len(y)):
        return terms, np.array([-4.0, 0.5, 0.5, 1.0])
    return terms, logistic(made[:, 1:], y)


def score(docs: DataFrame, marks: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = narrow(docs, id_col, text_col)
    terms, beta = fit(rows, marks, label_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    logit = F.lit(float(beta[0]))
    for f, b in zip(FEATURES, beta[1:]):
        logit = logit + F.col(f) * float(b)
    value = 1 / (1 + F.exp(-logit))
    return matched(rows, terms, "doc_id", kind).select(
        "doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), value.alias("score"),
        (value >= THRESHOLD).cast("int").alias("predicted"),
    )
