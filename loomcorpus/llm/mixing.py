"""Soft-membership mixing to target weights, with DataFrame and SQL functions only.

A classifier, counted on a labelled table, gives each document a posterior over domains.  Nonnegative
rates, one for each document, are then fitted so that the expected tokens of each domain (rate times
tokens times posterior) meet targets in least squares: projected gradient steps, taken in the metric
of the domains' Gram matrix over the documents that are free to move.  Documents with one posterior
move alike, so their tokens are summed once; a step aggregates that small table and writes it anew with
the next rates, and a document's rate is that of its posterior.  Tokens are words here.

The targets are the weights' shares of `total` tokens.  Without a total it is so large that the domain
`keep` needs `surplus` times what it has, and at least what there is.  `most_rate` bounds the rates from
above: with 1 no document is repeated, and domains that can't give their share stay short.  Whatever domain is
then off its weight is named in a warning, and so is a fit that neither meets its targets nor stands still after
`steps` steps; `residual` says what is missed.

Defined cases: a null or empty text has no tokens, the prior as posterior and the rate of its posterior;
repeated rows get equal rates; documents without labels, and labels that are null or repeated (smallest
counts), are no hindrance; a domain without mass can't meet its target, the others still do; without
labelled rows all domains are equally likely; other columns are kept; empty tables give no rows.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcorpus.llm.common import discard, written

SPACE = r"[\x20\x09-\x0D]+"
DOMAINS = ("clean", "low", "toxic")
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Params:
    sample_rows: int = 12_000  # labelled rows used for counting at most: those with the smallest hash
    terms: int = 120  # that mark a domain, at most
    least_rows: int = 5  # of the domain that hold a marking term, and at least this share of them:
    least_share: float = 0.008
    lift: float = 10.0  # the term's share of the domain's rows over its share of the others
    prefix: int = 5  # a term is the beginning of a word
    weights: dict[str, float] = field(default_factory=lambda: {"clean": 0.92, "low": 0.05, "toxic": 0.03})
    total: float | None = None  # tokens that are wanted in all
    keep: str = "clean"  # without a total, this domain needs `surplus` times the tokens it has
    surplus: float = 1.05
    most_rate: float = math.inf
    steps: int = 40
    halvings: int = 12  # lengths of a step that are tried
    tolerance: float = 1e-9


def words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE), lambda w: w != "")


def with_features(docs: DataFrame, p: Params, text_col: str = "text") -> DataFrame:
    """Columns __tokens, __terms (distinct beginnings of words) and __cell (length, repetition and symbols as one number)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("__words", words(text_col)).withColumn("__once", F.array_distinct("__words"))
    n = F.size("__words")
    length = F.least(F.floor(F.log2(n + 1)), F.lit(15))
    spread = F.floor(F.size("__once") * 10 / F.greatest(n, F.lit(1)))
    symbols = F.least(F.floor((F.length(text) - F.length(F.translate(text, SYMBOLS, ""))) * 5 / F.greatest(n, F.lit(1))), F.lit(10))
    return rows.withColumns({
        "__tokens": n.cast("long"),
        "__terms": F.array_distinct(F.transform("__once", lambda w: F.substring(w, 1, p.prefix))),
        "__cell": (length * 1000 + spread * 20 + symbols).cast("int"),
    }).drop("__words", "__once")


def domain(quality: str = "quality", toxic: str = "toxic") -> Column:
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 0, "low").otherwise("clean")


@dataclass(frozen=True)
class Classifier:
    """Logarithms of priors and likelihoods over DOMAINS, of cells and of how many marking terms a text holds."""

    priors: list[float]
    marks: dict[str, list[str]]  # terms that mark a domain
    cells: dict[int, list[float]]
    hits: dict[int, list[float]]

    def hit_key(self) -> Column:
        """How many marking terms of each domain a text holds, as one number; four or more count as four."""
        key = F.lit(0)
        for terms in self.marks.values():
            found = F.size(F.array_intersect("__terms", F.array(*(F.lit(t) for t in terms)))) if terms else F.lit(0)
            key = key * 5 + F.least(found, F.lit(4))
        return key.cast("int")

    def with_posterior(self, rows: DataFrame) -> DataFrame:
        """Columns __p0, __p1, ... of rows with __terms and __cell."""
        rows = rows.withColumn("__hits", self.hit_key())
        found = {}
        for column, table in (("__cell", self.cells), ("__hits", self.hits)):
            if table:
                unseen = F.array(*(F.lit(min(v[d] for v in table.values())) for d in range(len(DOMAINS))))
                logs = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
                found[f"{column}_logs"] = F.coalesce(F.try_element_at(logs, F.col(column)), unseen)
        rows = rows.withColumns(found)
        rows = rows.withColumns({f"__z{d}": sum((F.get(c, F.lit(d)) for c in found), F.lit(self.priors[d])) for d in range(len(DOMAINS))})
        most = F.greatest(*(F.col(f"__z{d}") for d in range(len(DOMAINS))))
        rows = rows.withColumns({f"__e{d}": F.exp(F.col(f"__z{d}") - most) for d in range(len(DOMAINS))})
        whole = sum((F.col(f"__e{d}") for d in range(1, len(DOMAINS))), F.col("__e0"))
        rows = rows.withColumns({f"__p{d}": F.col(f"__e{d}") / whole for d in range(len(DOMAINS))})
        return rows.drop("__hits", *found, *(f"__{x}{d}" for x in "ze" for d in range(len(DOMAINS))))


def fit_classifier(docs: DataFrame, labelled: DataFrame, p: Params, label: Column | None = None) -> Classifier:
    """Naive Bayes over cells and counts of marking terms, counted on a bounded sample of the labelled rows."""
    label = domain() if label is None else label
    known = labelled.select("doc_id", label.alias("__d")).filter("doc_id IS NOT NULL AND __d IS NOT NULL").groupBy("doc_id").agg(F.min("__d").alias("__d"))
    picked = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample_rows))  # at most sample_rows rows
    rows = written(with_features(docs.select("doc_id", "text").join(picked, "doc_id"), p).select("__d", "__terms", "__cell"), "labelled")
    per = [F.coalesce(F.sum(F.when(F.col("__d") == d, 1).otherwise(0)), F.lit(0)).alias(d) for d in DOMAINS]
    count = rows.agg(*per).first().asDict()
    total = sum(count.values())
    if not total:
        return Classifier([0.0] * len(DOMAINS), {}, {}, {})

    def logs(key: str, of: DataFrame) -> dict[int, list[float]]:
        found = {r["k"]: r for r in of.groupBy(F.col(key).alias("k")).agg(*per).collect()}  # a fixed number of keys
        return {k: [math.log((r[d] + 0.5) / (count[d] + 0.5 * len(found))) for d in DOMAINS] for k, r in found.items()}

    sums = rows.select("__d", F.explode("__terms").alias("t")).groupBy("t").agg(*per)
    share = {d: F.col(d) / max(1, count[d]) for d in DOMAINS}
    marks = {}
    for d in DOMAINS[1:]:
        rest = sum((share[x] for x in DOMAINS if x != d), F.lit(0.0))
        sure = (F.col(d) >= F.greatest(F.lit(p.least_rows), F.lit(p.least_share * count[d]))) & (share[d] > p.lift * rest)
        marks[d] = [r["t"] for r in sums.filter(sure).orderBy(F.desc(d), "t").limit(p.terms).collect()]
    model = Classifier([math.log((count[d] + 1) / (total + len(DOMAINS))) for d in DOMAINS], marks, {}, {})
    return Classifier(model.priors, marks, logs("__cell", rows), logs("__hits", rows.withColumn("__hits", model.hit_key())))


Step = tuple[list[float], list[float]]


def free(lack: list[float], most: float) -> Column:
    """Whether a rate isn't at a bound that what is lacking pulls it against."""
    r, pull = F.col("__rate"), along(lack)
    return ((r > 1e-9) | (pull > 0)) & ((r < most * (1 - 1e-9)) | (pull < 0))


def moved(lack: list[float], way: list[float], most: float, length: Column | None = None) -> Column:
    """The rates after a step of some length: rate + length * posterior . way, between 0 and most, where they are free."""
    to = along(way) if length is None else length * along(way)
    r = F.greatest(F.lit(0.0), F.col("__rate") + to)
    return F.when(free(lack, most), F.least(F.lit(float(most)), r) if most < math.inf else r).otherwise(F.col("__rate"))


def along(step: list[float]) -> Column:
    return sum((F.col(f"__p{d}") * F.lit(float(x)) for d, x in enumerate(step)), F.lit(0.0))


@dataclass(frozen=True)
class Mixture:
    steps: list[Step]
    targets: list[float]
    reached: list[float]
    residual: float  # the most that a domain misses, as a share of the total
    classes: DataFrame  # the posteriors with their __rate, fewer than 50,000
    rows: DataFrame  # the documents with __tokens, __p0, ..., a written table


def scored(docs: DataFrame, labelled: DataFrame, params: Params, columns: list[str]) -> DataFrame:
    """These columns of the documents, __tokens, __p0, ... and __draw: written, so the texts are read once."""
    rows = fit_classifier(docs, labelled, params).with_posterior(with_features(docs, params))
    post = [f"__p{d}" for d in range(len(DOMAINS))]
    return written(rows.select(*columns, "__tokens", *post, draw("doc_id", "text").alias("__draw")), "posteriors")


def fit(docs: DataFrame, labelled: DataFrame, params: Params = Params(), columns: list[str] | None = None) -> Mixture:
    """Fit classifier and rates; columns: those of the documents that the mixture's rows have, by default the id."""
    rows = scored(docs, labelled, params, ["doc_id"] if columns is None else columns)
    return Mixture(*fit_rates(rows, params), rows)


def wanted(mass: np.ndarray, p: Params) -> np.ndarray:
    """The domains' targets, for what they have."""
    weights, at = np.array([p.weights[d] for d in DOMAINS]) / sum(p.weights.values()), DOMAINS.index(p.keep)
    if p.total is not None or not weights[at]:
        return weights * (mass.sum() if p.total is None else p.total)
    return weights * max(mass.sum(), p.surplus * mass[at] / weights[at])


def fit_rates(rows: DataFrame, params: Params = Params()) -> tuple[list[Step], list[float], list[float], float, DataFrame]:
    """(steps, targets, reached, residual, classes) of rows with __tokens and __p0, ....

    Projected gradient steps in the metric of the free documents' Gram matrix; of a few lengths of each step the best is taken.
    """
    p, k = params, len(DOMAINS)
    post = [f"__p{d}" for d in range(k)]
    # Cells times hits are fewer than 50,000, so the classes are, whatever the input.
    classes = written(rows.groupBy(*post).agg(F.sum("__tokens").cast("double").alias("t")).withColumn("__rate", F.lit(float(min(1.0, p.most_rate)))), "posterior_classes")
    lengths = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(0.5**i).alias("by")) for i in range(p.halvings))))

    def sums(table: DataFrame, columns: list[Column]) -> np.ndarray:
        return np.array([x or 0.0 for x in table.agg(*(F.sum(x) for x in columns)).first()], dtype=float).reshape(-1, k)

    mass = sums(classes, [F.col("__rate") * F.col("t") * F.col(x) for x in post])[0]
    targets, steps, still = wanted(mass / min(1.0, p.most_rate), p), [], False
    whole = targets.sum()
    slack = p.tolerance * max(1.0, whole)
    for _ in range(p.steps):
        lack = (targets - mass).tolist()
        if max(map(abs, lack)) <= slack:
            break
        gram = sums(classes.filter(free(lack, p.most_rate)), [F.col("t") * F.col(a) * F.col(b) for a in post for b in post])
        way = (np.linalg.pinv(gram) @ lack).tolist()
        tries = classes.withColumn("__l", lengths).withColumn("__rate", moved(lack, way, p.most_rate, F.col("__l.by")))
        found = tries.groupBy("__l.i").agg(*(F.sum(F.col("__rate") * F.col("t") * F.col(x)).alias(f"s{x}") for x in post)).orderBy("i").collect()  # a row for each length
        tried = np.array([[r[f"s{x}"] for x in post] for r in found])
        gaps = np.linalg.norm(targets - tried, axis=1)
        best = int(gaps.argmin())
        still = bool(gaps[best] >= np.linalg.norm(lack) - slack)
        if still:
            break
        way = [x * 0.5**best for x in way]
        steps.append((lack, way))
        last, classes = classes, written(classes.withColumn("__rate", moved(lack, way, p.most_rate)), "posterior_classes")
        discard(last)
        mass = tried[best]
    residual = float(np.abs(targets - mass).max() / max(1.0, whole))
    if residual > p.tolerance and not still:
        warnings.warn(f"after {p.steps} steps the mixture misses a target by {residual:.2%} of all tokens", stacklevel=2)
    weights, shares = np.array([p.weights[d] for d in DOMAINS]) / sum(p.weights.values()), mass / max(1.0, mass.sum())
    if p.most_rate < math.inf and mass.sum() and (np.abs(weights - shares) > 0.01 * weights).any():
        warnings.warn("domains off their weights: " + ", ".join(f"{d} has {x:.2%} of the tokens for {w:.2%}" for d, x, w in zip(DOMAINS, shares, weights, strict=True) if abs(w - x) > 0.01 * w), stacklevel=2)
    return steps, targets.tolist(), mass.tolist(), residual, classes


def draw(id_col: str, text_col: str) -> Column:
    """A number in [0, 1) that follows from id and text."""
    return F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1_000_003)) / 1_000_003.0


def copies() -> Column:
    return F.floor(F.col("__rate") + F.col("__draw")).cast("int")


def rated(mixture: Mixture) -> DataFrame:
    """The mixture's rows with __rate and __copies: the rate, rounded by a number drawn from id and text."""
    post = [f"__p{d}" for d in range(len(DOMAINS))]
    return mixture.rows.join(F.broadcast(mixture.classes.select(*post, "__rate")), post).withColumn("__copies", copies())


def mix(docs: DataFrame, labelled: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents, each as often as its rate says; same columns."""
    rows = rated(fit(docs, labelled, params, docs.columns))
    return rows.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col("__copies"))).alias("__one")).drop("__one")


def op10_mixing(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row per document: its posteriors, rate and copies."""
    post = [F.col(f"__p{i}").alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return rated(fit(docs, labelled)).select("doc_id", F.col("__tokens").alias("tokens"), *post, F.col("__rate").alias("rate"), F.col("__copies").cast("long").alias("copies"))
