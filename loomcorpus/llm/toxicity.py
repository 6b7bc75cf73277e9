"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon (whole words, and stems that open a word) is a trie.  Its Levenshtein automaton for one
edit is run on every word: a state is the set of trie nodes reached with the edits spent so far, so
all terms are tried at once and most words die after a few letters.  States are made as they are met.
Each hit is weighed by the words around it: inside quotation marks or after a verb of speech it counts
as quoted, otherwise as abuse.  A logistic model, fitted on labelled rows, turns the sums into a score.

How pure a learned term must be and how short a stem may be is chosen by cross-validation among the training
rows alone: texts are dealt into folds, terms and weights are learned without a fold, and the setting whose
scores of the folds left out have the least log loss is taken (of equals the purest).  One automaton of all
candidate terms serves every setting: it says which terms a word meets, and a setting is a choice of terms.

Defined cases: a null or empty text has no hits and gets the score of no hits; rows are scored one by
one, so repeated rows agree; a null id is scored too and never trains; label rows that are null,
repeated (smallest label counts) or without a document are passed over; without labels of both kinds the
seed lexicon and fixed weights are used; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcorpus.llm.common import arrow_map, written

#: Terms that need no labels.
SEED_TERMS = ["idiot", "moron", "stupid", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown"]
#: Verbs of speech that open a quotation.
SPEECH = {"said", "says", "wrote", "writes", "called", "quoted", "quote", "replied", "dit", "écrit", "sagte", "schrieb", "dijo", "escribió"}
WORD = re.compile(r"[^\W_]+")
QUOTES = "\"“”„«»‘’"
FEATURES = ["exact", "stem", "near", "quoted", "per_word", "any"]


@dataclass(frozen=True)
class Params:
    sample_rows: int = 12_000  # labelled rows used for training at most: those with the smallest hash
    folds: int = 5  # rows whose crc32(id) is divisible are held out
    terms: int = 600  # learned at most
    candidates: int = 2400  # terms that any setting may choose from, those of the most toxic rows
    least_rows: int = 5  # toxic rows that hold a learned term, and at least this share of them:
    least_share: float = 0.008
    purities: tuple[float, ...] = (0.9, 0.8, 0.7, 0.6, 0.5)  # share of toxic rows among those that hold it, smoothed
    stems: tuple[tuple[int, ...], ...] = ((4, 5, 6), (5, 6), (6,))  # lengths of stems
    parts: int = 3  # of the training rows, for choosing among purities and stems
    edits_from: int = 5  # shorter terms must match exactly
    window: int = 8  # words on either side


class Automaton:
    """The Levenshtein automaton (one edit) of a lexicon; stems match where a word begins with them, without edits."""

    MOST = 200_000  # states and words that are remembered

    def __init__(self, words: list[str], stems: list[str], edits_from: int) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.word_end: dict[int, str] = {}
        self.stem_end: dict[int, str] = {}
        for terms, ends in ((words, self.word_end), (stems, self.stem_end)):
            for term in terms:
                node = 0
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                    node = self.children[node][c]
                ends[node] = term
        self.edits_from = edits_from
        self._forget()

    def _forget(self) -> None:
        start = self._closed({(0, 0)})
        self.states, self.numbers, self.next, self.found = [start], {start: 0}, [{}], [self._terms(start)]
        self.words: dict[str, tuple] = {}

    def _closed(self, reached: set[tuple[int, int]]) -> frozenset:
        """With the nodes that a missing letter reaches."""
        more = {(child, 1) for node, edits in reached if not edits for child in self.children[node].values()}
        return frozenset(reached | {x for x in more if (x[0], 0) not in reached})

    def _terms(self, state: frozenset) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """The terms written exactly, and those with one edit that are long enough for it."""
        ends = [(self.word_end[n], e) for n, e in state if n in self.word_end]
        return tuple(t for t, e in ends if not e), tuple(t for t, e in ends if e and len(t) >= self.edits_from)

    def _step(self, number: int, c: str) -> int:
        reached = set()
        for node, edits in self.states[number]:
            if c in self.children[node]:
                reached.add((self.children[node][c], edits))
            if not edits:
                reached.add((node, 1))
                reached.update((child, 1) for child in self.children[node].values())
        state = self._closed({x for x in reached if not x[1] or (x[0], 0) not in reached})
        if not state:
            return -1
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.next.append({})
            self.found.append(self._terms(state))
        return self.numbers[state]

    def terms(self, word: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
        """The stems that the word begins with, the terms that it is, and the terms one edit from it."""
        known = self.words.get(word)
        if known is None:
            if len(self.states) > self.MOST or len(self.words) > self.MOST:
                self._forget()
            known = self.words[word] = self._look_up(word)
        return known

    def _look_up(self, word: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
        node, stems = 0, []
        for c in word:
            node = self.children[node].get(c, -1)
            if node < 0:
                break
            if node in self.stem_end:
                stems.append(self.stem_end[node])
        state = 0
        for c in word:
            step = self.next[state].get(c)
            if step is None:
                step = self.next[state][c] = self._step(state, c)
            if step < 0:
                return tuple(stems), (), ()
            state = step
        return (tuple(stems), *self.found[state])

    def match(self, word: str) -> int:
        """3: begins with a stem, 2: is a term, 1: is one edit from a term, 0: none."""
        return kind_of(self.terms(word))


def kind_of(terms: tuple, words: frozenset | None = None, stems: frozenset | None = None) -> int:
    """What a word is by the terms that it meets, of those in words and stems (all, if None)."""
    begins, exact, near = terms
    if begins and (stems is None or not stems.isdisjoint(begins)):
        return 3
    if exact and (words is None or not words.isdisjoint(exact)):
        return 2
    return int(bool(near) and (words is None or not words.isdisjoint(near)))


def hits(text: str | None, automaton: Automaton, p: Params) -> tuple[int, list[tuple[tuple, bool]]]:
    """The number of words of one whole text, and for each that meets terms: these, and whether it stands in a quotation."""
    low = (text or "").lower()
    words = WORD.findall(low)
    found = {w: met for w in set(words) if any(met := automaton.terms(w))}
    if not found:  # as most texts: where the words stand doesn't matter
        return len(words), []
    spans = [(m.start(), m.end()) for m in WORD.finditer(low)]
    out = []
    for i, (word, (start, end)) in enumerate(zip(words, spans, strict=True)):
        met = found.get(word)
        if met is None:
            continue
        a, b = spans[max(0, i - p.window)][0], spans[min(len(spans) - 1, i + p.window)][1]
        before, after = low[a:start], low[end:b]
        marks = sum(before.count(q) for q in QUOTES) % 2 == 1 and any(q in after for q in QUOTES)
        speech = ":" in before and any(low[x:y] in SPEECH for x, y in spans[max(0, i - p.window) : i])
        out.append((met, marks or speech))
    return len(spans), out


def features(n_words: int, found: list[tuple[tuple, bool]], words: frozenset | None = None, stems: frozenset | None = None) -> list[float]:
    """The sums over the hits of one whole text, in the order of FEATURES."""
    sums = Counter()
    for met, quoted in found:
        if kind := kind_of(met, words, stems):
            sums["quoted" if quoted else ("", "near", "exact", "stem")[kind]] += 1
    abuse = sum(sums.values()) - sums["quoted"]
    return [*(math.log1p(sums[f]) for f in FEATURES[:4]), 100.0 * abuse / max(1, n_words), float(abuse > 0)]


@dataclass(frozen=True)
class Model:
    words: list[str]
    stems: list[str]
    weights: list[float]  # of FEATURES, then the constant
    params: Params
    setting: tuple | None = None  # purity and stem lengths, if chosen by labelled rows

    def score(self, x: list[float]) -> float:
        z = float(np.dot(self.weights[:-1], x) + self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


DEFAULT_WEIGHTS = [1.5, 1.5, 0.5, -1.0, 0.3, 2.0, -3.0]


def held_out(id_col: str, p: Params):
    """Whether crc32 of the id as text is divisible; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % p.folds == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    """(text, label, part) of a bounded sample of the labelled rows that aren't held out; equal texts are in one part."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).filter(~held_out("doc_id", p)).groupBy("doc_id").agg(F.min("toxic").cast("int").alias("label"))
    picked = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample_rows))  # at most sample_rows rows
    rows = docs.select("doc_id", "text").join(picked, "doc_id")
    return rows.select("text", "label", F.pmod(F.xxhash64("text"), F.lit(p.parts)).cast("int").alias("part"))


def term_counts(rows: DataFrame, p: Params) -> list[dict]:
    """The candidate terms: term, and of each part the toxic and the clean rows that hold it.

    Each task counts its rows' terms; sums and filters are Spark's.  Terms that no setting could choose don't leave it.
    """
    lengths = sorted({n for s in p.stems for n in s})
    names = [f"{x}{i}" for x in "tc" for i in range(p.parts)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}

        def rows_of() -> Iterator[pa.RecordBatch]:
            terms = list(sums)
            for a in range(0, len(terms), 50_000):
                some = terms[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([sums[t][i] for t in some], pa.int64()) for i in range(2 * p.parts))], names=["term", *names])
            sums.clear()

        for batch in batches:
            for text, label, part in zip(*batch.columns, strict=True):
                at = part.as_py() + (0 if label.as_py() else p.parts)
                for t in terms_of(text.as_py(), lengths):
                    sums.setdefault(t, [0] * (2 * p.parts))[at] += 1
            if len(sums) > 500_000:
                yield from rows_of()
        yield from rows_of()

    counts = rows.select("text", "label", "part").mapInArrow(count, "term string, " + ", ".join(f"{n} long" for n in names)).groupBy("term").agg(*(F.sum(n).alias(n) for n in names))
    t, c = (sum(F.col(f"{x}{i}") for i in range(p.parts)) for x in "tc")
    pure = [tt / (tt + cc + 0.5) >= min(p.purities) for tt, cc in [(t, c), *((t - F.col(f"t{i}"), c - F.col(f"c{i}")) for i in range(p.parts))]]
    some = pure[0]
    for x in pure[1:]:
        some = some | x
    found = counts.filter((t >= p.least_rows) & some).orderBy(t.desc(), "term").limit(p.candidates).collect()
    return [{"term": r["term"], "t": [r[f"t{i}"] for i in range(p.parts)], "c": [r[f"c{i}"] for i in range(p.parts)]} for r in found]


def terms_of(text: str | None, lengths: list[int]) -> set[str]:
    """The words of a text, and their beginnings, marked by a star."""
    words = {w for w in WORD.findall((text or "").lower()) if 3 < len(w) < 40}
    return words | {f"{w[:n]}*" for w in words for n in lengths if len(w) > n}


def chosen_terms(counts: list[dict], toxic: list[int], purity: float, lengths: tuple[int, ...], without: int | None, p: Params) -> tuple[frozenset, frozenset]:
    """(words, stems) by the rows outside one part (all parts, if None); toxic: the number of toxic rows of each part."""
    parts = [i for i in range(p.parts) if i != without]
    least = max(p.least_rows, p.least_share * sum(toxic[i] for i in parts))
    found = []
    for r in counts:
        t, c = (sum(r[x][i] for i in parts) for x in "tc")
        if t >= least and t / (t + c + 0.5) >= purity and not (r["term"].endswith("*") and len(r["term"]) - 1 not in lengths):
            found.append((-t, r["term"]))
    found = sorted(found)[: p.terms]
    whole = {term: -t for t, term in found if not term.endswith("*")}
    words, stems = {*SEED_TERMS}, set()
    for t, name in sorted(found, key=lambda x: (len(x[1]), x[1])):
        term = name.removesuffix("*")
        if any(term[:n] in stems for n in lengths):
            continue
        if not name.endswith("*"):
            words.add(term)
        elif -4 * t >= 5 * max((n for w, n in whole.items() if w.startswith(term)), default=0):
            stems.add(term)  # else one word and little else begins with it
    return frozenset(words), frozenset(stems)


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """Learn setting, lexicon and weights from a bounded sample of labelled rows, at most sample_rows; written once, read twice."""
    p = params
    rows = written(training_rows(docs, labels, p), "toxicity_sample")
    counts = term_counts(rows, p)
    sizes = {(r["part"], r["label"]): r["n"] for r in rows.groupBy("part", F.coalesce(F.col("label") != 0, F.lit(False)).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = [sizes.get((i, True), 0) for i in range(p.parts)]
    settings = [(x, s) for s in p.stems for x in p.purities]
    lexicons = [chosen_terms(counts, toxic, x, s, i, p) for x, s in settings for i in (*range(p.parts), None)]
    all_words, all_stems = (sorted(frozenset().union(*(x[k] for x in lexicons))) for k in (0, 1))
    width = len(FEATURES)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, out = _automaton(all_words, all_stems, p.edits_from), []
        for text in batch.column(0):
            n, found = hits(text.as_py(), a, p)
            out.append([x for words, stems in lexicons for x in features(n, found, words, stems)] if found else None)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float32())), batch.column(1), batch.column(2)], names=["x", "label", "part"])

    sample = arrow_map(rows, fn, "x array<float>, label int, part int").collect()  # sample_rows rows of a few numbers for each lexicon
    y = np.array([bool(r["label"]) for r in sample], dtype=float)
    if not len(y) or y.min() == y.max():
        words, stems = lexicons[p.parts]
        return Model(sorted(words), sorted(stems), DEFAULT_WEIGHTS, p)
    x = np.zeros((len(y), len(lexicons), width + 1))
    x[:, :, width] = 1
    for i, r in enumerate(sample):
        if r["x"] is not None:
            x[i, :, :width] = np.array(r["x"]).reshape(len(lexicons), width)
    part = np.array([r["part"] for r in sample])
    losses = []
    for s in range(len(settings)):
        loss = 0.0
        for i in range(p.parts):
            own, rest = x[part == i, s * (p.parts + 1) + i], x[part != i, s * (p.parts + 1) + i]
            if len(own) and len(rest):
                z = np.clip(own @ newton(rest, y[part != i]), -30, 30)
                loss += float((np.logaddexp(0, z) - y[part == i] * z).sum())
        losses.append(loss)
    best = int(np.argmin(np.round(losses, 9)))
    at = best * (p.parts + 1) + p.parts
    words, stems = lexicons[at]
    return Model(sorted(words), sorted(stems), newton(x[:, at], y).tolist(), p, settings[best])


def newton(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Logistic regression with a ridge on all weights but the constant."""
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + keep, x.T @ (y - q) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


_automata: dict[tuple, Automaton] = {}


def _automaton(words: list[str], stems: list[str], edits_from: int) -> Automaton:
    key = (tuple(words), tuple(stems), edits_from)
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(words, stems, edits_from)
    return _automata[key]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, hits): every whole text, in one map over the rows."""
    automaton_of = (model.words, model.stems, model.params.edits_from)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        a = _automaton(*automaton_of)
        x = [features(*hits(t.as_py(), a, model.params)) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(v) for v in x]), pa.array(x, pa.list_(pa.float64()))], names=["id", "score", "features"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(narrow, fn, f"id {kind}, score double, features array<double>").withColumnRenamed("id", id_col)


def op9_toxicity(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """The contract's columns."""
    scored = score(docs, fit(docs, labels, params))
    return scored.select("doc_id", held_out("doc_id", params).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
