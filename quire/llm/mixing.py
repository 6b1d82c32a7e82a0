"""Mixing documents to target weights of domains that only some labels tell.

A classifier learnt from a labelled table gives every document posteriors over the domains: a
logistic regression on the text's shape and on which of CHOSEN out of BUCKETS hashed words occur,
fitted on a bounded sample. Rates r >= 0
of all documents are then fitted so that the expected tokens of each domain, the sum over
documents of n p(domain) r, meet target * budget: least squares over the domains by projected
gradient from r = 1. The gradient of a document depends on its posteriors and on the domains'
residuals alone, so a step is one aggregate of a few numbers. Residuals are weighted by the inverse
of the domains' Gram matrix over the documents that aren't at a bound, which meets the targets in
one step while none is; where that doesn't bring them nearer, by the inverse of the domains' sizes,
which always does. `Mix.converged` tells whether the targets are met; where STEPS don't suffice or rates
can't meet them a warning says how far off they are.
Posteriors are told in steps of 1 / GRID: documents that have them in common move together, so
that the steps run over one row for each different vector with its tokens summed up.

DataFrame functions only. The driver sees the sample's features and the domains' sums; texts are
not shuffled. Sampled ids are broadcast, PER_DOMAIN a domain at most.

Cases: null and empty texts have no tokens and the posteriors of a text without words; labels of unknown ids,
null labels and ids teach nothing; a repeated label counts once; targets of domains that no label
has are left out and the others scaled up; without any label every rate is 1; repeated rows get
equal rates; an empty table gives no rows; other columns are kept by `sampled` and not read.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, first_rows, literal, spare, written

BUCKETS, PER_DOMAIN, CHOSEN, LEAST = 1 << 15, 2_000, 512, 10
FIT_STEPS, FIT_RATE, DECAY = 300, 0.05, 1e-3
STEPS, GOOD_ENOUGH, STILL, DEEP, GRID = 60, 5e-4, 1e-5, 8, 1000
#: A rate this near a whole number is taken as it: no more than sums of doubles err by.
WHOLE = 1e-9


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def n_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"\S+")).cast("long")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))


def _shape(text: Column, words: Column, different: Column) -> list[Column]:
    """Numbers about the whole text: length, symbols, digits, capitals, bars, repeated words and their length."""
    size = F.greatest(F.length(text), F.lit(1))
    n = F.greatest(F.size(words), F.lit(1))
    share = lambda chars: F.regexp_count(text, F.lit(f"[{chars}]")) / size
    return [F.log1p(F.size(words).cast("double")), share("#$%&*!?@^~<>="), share("0-9"), (text == F.upper(text)).cast("double"), share("|"), F.size(different) / n, size / n]


SHAPES = 7


@dataclass
class Classifier:
    """Multinomial logistic regression: weights of the domains for a constant, the shapes, and buckets of words that occur."""

    domains: list[str]
    constant: list[float] = field(default_factory=list)
    shapes: list[list[float]] = field(default_factory=list)
    chosen: list[int] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)

    def add(self, df: DataFrame, text_col: str = "text", name: str = "p") -> DataFrame:
        """df with the array of the domains' posteriors; each step is a projection of its own, so that texts are split once."""
        if len(self.domains) < 2:
            return df.withColumn(name, F.array(*[F.lit(1.0)] * len(self.domains)))
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        # what is read more than once is a projection of its own, which the optimizer doesn't repeat
        words, different, seen, odds, e, others = (spare(df, f"{name}_{x}") for x in ("words", "different", "seen", "odds", "e", "others"))
        df = df.withColumn(words, _words(text)).withColumn(different, F.array_distinct(words))
        inside = F.array_intersect(_hashed(F.col(different)), literal(self.chosen or [-1], "int"))
        df = df.withColumn(seen, F.struct(F.array(*_shape(text, F.col(words), F.col(different))).alias("shape"), inside.alias("in"))).drop(words, different)
        all_odds = []
        for c, shape, weights in zip(self.constant, self.shapes, self.weights, strict=True):
            own = [0.0] * BUCKETS
            for b, w in zip(self.chosen, weights, strict=True):
                own[b] = w
            all_odds.append(sum((F.element_at(F.col(seen)["shape"], i + 1) * F.lit(w) for i, w in enumerate(shape)), F.lit(c)) + _summed(F.col(seen)["in"], literal(own, "double")))
        df = df.withColumn(odds, F.array(*all_odds)).drop(seen)
        df = df.withColumn(e, F.transform(odds, lambda x: F.exp(x - F.array_max(odds)))).drop(odds)
        total = sum((F.element_at(e, i + 2) for i in range(len(all_odds) - 1)), F.element_at(e, 1))
        df = df.withColumn(others, F.array(*[F.round(F.element_at(e, i + 2) / total * GRID) for i in range(len(all_odds) - 1)])).drop(e)
        first = F.greatest(F.lit(0.0), F.lit(float(GRID)) - F.aggregate(others, F.lit(0.0), lambda a, x: a + x))
        return df.withColumn(name, F.transform(F.concat(F.array(first), F.col(others)), lambda x: x / GRID)).drop(others)


def _summed(found: Column, weights: Column) -> Column:
    return F.aggregate(found, F.lit(0.0), lambda a, b: a + F.element_at(weights, b + 1))


def fit(docs: DataFrame, labels: DataFrame, per_domain: int = PER_DOMAIN, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> Classifier:
    """A classifier from labels (id, domain): the sample is per_domain rows of each domain at most, those of the least hash.

    Buckets are chosen by how unevenly the domains hold them; the regression runs on the driver, over the sample."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(domain_col).cast("string").alias("domain")).dropna().distinct()
    sampled = first_rows(known, "domain", F.xxhash64("id"), ["id"], per_domain)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sampled), "id")
    rows = first_rows(rows, "domain", F.xxhash64("id", text), ["id"], per_domain)  # an id may have many rows
    rows = rows.withColumn("words", _words(text)).withColumn("different", F.array_distinct("words"))
    rows = cut(rows.select("id", "domain", F.array(*_shape(text, F.col("words"), F.col("different"))).alias("shape"), F.array_distinct(_hashed(F.col("different"))).alias("in")))
    size = {r.domain: r["count"] for r in rows.groupBy("domain").count().collect()}
    domains, every = sorted(size), sum(size.values())
    if len(domains) < 2:
        return Classifier(domains)
    counts = rows.select("domain", F.explode("in").alias("bucket")).groupBy("bucket").pivot("domain", domains).count().na.fill(0)
    all_in = sum((F.col(f"`{d}`") for d in domains[1:]), F.col(f"`{domains[0]}`"))
    uneven = sum((F.pow(F.col(f"`{d}`") - all_in * size[d] / every, 2) / (all_in * size[d] / every) for d in domains), F.lit(0.0))  # chi-squared
    chosen = sorted(r.bucket for r in counts.filter(all_in >= LEAST).orderBy(F.desc(uneven), "bucket").select("bucket").limit(CHOSEN).collect())
    place = {b: i for i, b in enumerate(chosen)}
    seen = rows.select("id", "domain", "shape", F.array_intersect("in", literal(chosen or [-1], "int")).alias("in")).collect()
    seen.sort(key=lambda r: (r.id, r.domain))
    x = np.zeros((len(seen), SHAPES + len(chosen)))
    for i, r in enumerate(seen):
        x[i, :SHAPES] = r.shape
        x[i, [SHAPES + place[b] for b in r["in"]]] = 1
    y = np.array([domains.index(r.domain) for r in seen])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    spread[SHAPES:], mean[SHAPES:] = 1, 0
    w, c = _regression((x - mean) / spread, y, len(domains))
    w /= spread[:, None]
    c = c - mean @ w
    return Classifier(domains, [round(float(v), 9) for v in c], [[float(v) for v in w[:SHAPES, d]] for d in range(len(domains))], chosen, [[round(float(v), 9) for v in w[SHAPES:, d]] for d in range(len(domains))])


def _regression(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and constants by Adam on the cross entropy with decay."""
    w, c, target = np.zeros((x.shape[1], k)), np.zeros(k), np.eye(k)[y]
    params, moments = [w, c], [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(c), np.zeros_like(c)]]
    for step in range(1, FIT_STEPS + 1):
        z = x @ w + c
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True) - target) / len(x)
        for q, g, (m, v) in zip(params, (x.T @ p + DECAY * w, p.sum(axis=0)), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= FIT_RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, c


def _least(p: Column, keep: int | None) -> Column:
    """The least rate: 0, or 1 for documents that are most likely of the domain to keep."""
    return F.lit(0.0) if keep is None else F.when(F.element_at(p, keep + 1) >= F.array_max(p), F.lit(1.0)).otherwise(F.lit(0.0))


def _rate(start: Column, steps: list[list[float]], p: Column, keep: int | None = None) -> Column:
    """The rate after gradient steps; each has a number for every domain.

    With the place of a domain to keep, no rate exceeds 1 and documents that are most likely of it have 1."""
    if not steps:
        return start
    n = len(steps[0])
    flat = literal([x for step in steps for x in step], "double")
    moved = lambda r, k: r - sum((F.element_at(p, d + 1) * F.element_at(flat, k * n + d + 1) for d in range(n)), F.lit(0.0))
    within = lambda r: F.greatest(_least(p, keep), r if keep is None else F.least(F.lit(1.0), r))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), start, lambda r, k: within(moved(r, k)))


@dataclass
class Mix:
    """What was fitted: the rate of a document follows from its posteriors and the steps."""

    classifier: Classifier
    targets: list[float]
    steps: list[list[float]]
    tokens: list[float]  # expected tokens of each domain at these rates
    wanted: list[float]
    keep: int | None = None  # place of the domain whose documents all stay
    converged: bool = True

    def rate(self, p: Column) -> Column:
        return _rate(F.lit(1.0), self.steps, p, self.keep)


def solve(classifier: Classifier, table: DataFrame, targets: dict[str, float], budget: float | None = None) -> Mix:
    """Fits the rates of a table with n_tokens and the array p of posteriors.

    budget: the tokens wanted in all; None: as many as there are; 0: as many as the domain of the largest target
    allows, whose documents all stay: others are thinned out to their targets beside it or, where they are scarcer
    than that, stay as they are; nothing is repeated."""
    domains = classifier.domains
    wanted = [max(0.0, targets.get(d, 0.0)) for d in domains]
    if not sum(wanted):
        return Mix(classifier, wanted, [], [], [])
    wanted = [w / sum(wanted) for w in wanted]

    k = len(domains)

    def state(rate: Column, keep: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of each domain, and the Gram matrix of the documents that aren't at their least rate."""
        p, n, free = [F.element_at("p", d + 1) for d in range(k)], F.col("n_tokens"), F.col("rate") > _least(F.col("p"), keep)
        wanted = [n * p[d] * F.col("rate") for d in range(k)] + [F.when(free, n * p[d] * p[e]).otherwise(F.lit(0.0)) for d in range(k) for e in range(k)]
        row = np.array([float(x) for x in table.withColumn("rate", rate).agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(f"s{i}") for i, x in enumerate(wanted)]).first()])
        return row[:k], row[k:].reshape(k, k)

    table = cut(table.groupBy("p").agg(F.sum("n_tokens").cast("double").alias("n_tokens")))
    size, gram = state(F.lit(1.0), None)
    total = float(size.sum())
    if not total:
        return Mix(classifier, wanted, [], size.tolist(), size.tolist())
    keep = wanted.index(max(wanted)) if budget == 0 else None
    if keep is not None:
        _, gram = state(F.lit(1.0), keep)
    whole = size[keep] / wanted[keep] if keep is not None else total if budget is None else budget
    goal = np.array([w * whole if keep is None else min(s, w * whole) for s, w in zip(size, wanted, strict=True)])
    now, steps, start, done = size, [], F.lit(1.0), 0
    off = lambda at: float(np.abs(at - goal).max())
    while off(now) > GOOD_ENOUGH * total and len(steps) < STEPS:
        # Weighted by 1 / size the least-squares Hessian has no eigenvalue above 1, so that a step of 1 is safe.
        safe = [a / s if s else 0.0 for a, s in zip((now - goal).tolist(), size.tolist(), strict=True)]
        for step in ((np.linalg.pinv(gram, hermitian=True) @ (now - goal)).tolist(), safe):
            tried, gram_there = state(_rate(start, [*steps[done:], step], F.col("p"), keep), keep)
            if step is safe or off(tried) < 0.9 * off(now):
                break
        moved = float(np.abs(tried - now).max())
        steps, now, gram = [*steps, step], tried, gram_there
        if moved <= STILL * total:
            break  # as near as rates can come
        if len(steps) - done == DEEP:  # expressions stay of bounded depth
            table = cut(table.withColumn("r", _rate(start, steps[done:], F.col("p"), keep)))
            start, done = F.col("r"), len(steps)
    if not (met := off(now) <= GOOD_ENOUGH * total):
        warnings.warn(f"mixing: after {len(steps)} steps a domain is {off(now) / total:.4f} of all tokens off its target", stacklevel=2)
    return Mix(classifier, wanted, steps, now.tolist(), goal.tolist(), keep, met)


def drawn(rate: Column, key: Column) -> Column:
    """Whole copies: the whole part of the rate, and one more with the probability of the rest, by a hash of the key."""
    near = F.abs(rate - F.round(rate)) <= WHOLE
    u = F.pmod(F.xxhash64(F.lit("mix"), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.when(near, F.round(rate)).otherwise(F.floor(rate + u)).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> tuple[DataFrame, Mix]:
    """doc_id, n_tokens, p (posteriors by the mix's domains), rate, copies of every document; and the mix."""
    classifier = fit(docs, labels, id_col=id_col, text_col=text_col, domain_col=domain_col)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = cut(classifier.add(read).select("doc_id", n_tokens(F.col("text")).alias("n_tokens"), "p"))
    found = solve(classifier, table, targets, budget)
    return table.withColumn("rate", found.rate(F.col("p"))).withColumn("copies", drawn(F.col("rate"), F.col("doc_id"))), found


def sampled(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> DataFrame:
    """The rows of docs, each as often as its rate says, with their own columns; they are written with their posteriors once, so that texts are split once."""
    classifier = fit(docs, labels, id_col=id_col, text_col=text_col, domain_col=domain_col)
    p, n, copies, copy = (spare(docs, x) for x in ("mix_p", "mix_tokens", "mix_copies", "mix_copy"))
    scored = written(classifier.add(docs.withColumn(n, n_tokens(F.col(text_col))), text_col, p))
    found = solve(classifier, scored.select(F.col(n).alias("n_tokens"), F.col(p).alias("p")), targets, budget)
    counted = scored.withColumn(copies, drawn(found.rate(F.col(p)), F.col(id_col).cast("long")))
    return counted.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).select(*docs.columns)
