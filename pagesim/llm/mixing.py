"""Mixing sources to target weights with DataFrame functions only.

A naive Bayes classifier over hashed words, fitted on labelled rows, gives each document soft memberships in domains.
Rates r >= min_rate for the documents then minimise, with w the documents' shares of all tokens and p their memberships,

    1/2 (sum w p r - g t)' M^-1 (sum w p r - g t) + ridge/2 sum w (r - 1)^2,   M = sum w p p' + ridge I.

The gradient of a document's rate is the same for all documents but for p, so each round of projected gradient descent
sets r = max(min_rate, 1 - p' l) with one number l for each domain, sums one vector and one small matrix over the table
and moves l along the gradient, scaled by the curvature of the rates that are not at the bound; a step that would lead
down is shortened towards the plain one, which cannot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, labelled_sample, written

#: Word buckets of the classifier, the power of a text's length by which its evidence grows, the smoothing of its counts.
BITS, TEMPER, SMOOTHING = 13, 0.75, 0.5


def _buckets(text: Column) -> Column:
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return F.transform(words, lambda w: F.shiftrightunsigned(F.xxhash64(w), 64 - BITS).cast("int"))


@dataclass
class Model:
    domains: list[str]
    prior: list[float]
    table: DataFrame  # one row: `t`, for each domain an array of a log-likelihood for each bucket


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", domain: str = "domain", per_domain: int = 2000) -> Model:
    """Classifier from labels (doc_id, domain), from a sample bounded by per_domain rows of each domain.

    Priors cover all labelled rows. Labels without id or domain teach nothing; of several domains of an id the first in
    order counts; a text that is null has no words. There must be a label.
    """
    known = labels.where(F.col(domain).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(F.col(domain).cast("string")).alias("_d"))
    share = sorted(known.groupBy("_d").count().collect())
    if not share:
        raise ValueError("no labelled rows")
    domains, total = [r[0] for r in share], sum(r[1] for r in share)
    few = F.broadcast(labelled_sample(known, "_d", per_domain, ["_id"]))  # per_domain rows a domain
    words = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(few, "_id").select("_d", F.explode(_buckets(F.col("_t"))).alias("b"))
    every = docs.sparkSession.range(1 << BITS).select(F.col("id").cast("int").alias("b"))
    counts = every.join(words.groupBy("b").agg(*(F.count(F.when(F.col("_d") == d, 1)).alias(f"c{k}") for k, d in enumerate(domains))), "b", "left").fillna(0)
    ordered = counts.agg(F.sort_array(F.collect_list(F.struct("b", *(f"c{k}" for k in range(len(domains)))))).alias("rows"), *(F.sum(f"c{k}").alias(f"s{k}") for k in range(len(domains))))

    def column(k: int) -> Column:
        down = F.log(F.col(f"s{k}") + SMOOTHING * (1 << BITS))
        return F.transform("rows", lambda r: F.log(r[f"c{k}"] + SMOOTHING) - down)

    return Model(domains, [r[1] / total for r in share], written(ordered.select(F.array(*(column(k) for k in range(len(domains)))).alias("t")), "likelihoods"))


def posteriors(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_tokens (words) and a membership p_<domain> for each domain; they sum to 1.

    Words of one text are no independent evidence, so the log-likelihood of n words is scaled to that of n ** TEMPER. A
    null or empty text has no words and the priors as memberships.
    """
    names = [f"p_{d}" for d in model.domains]
    base = docs.drop("n_tokens", *names)
    b, t, *sums = free_names(base, "b", "t", *(f"s{k}" for k in range(len(names))))
    marked = base.withColumns({b: _buckets(F.col(text)), t: model.table.scalar()})

    def likelihood(k: int) -> Column:
        return F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(F.get(t, F.lit(k)), x))

    scored = marked.select(*(F.col(f"`{c}`") for c in base.columns), F.size(b).cast("bigint").alias("n_tokens"), *(likelihood(k).alias(c) for k, c in enumerate(sums)))
    scale = F.pow(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"), F.lit(TEMPER - 1))
    scored = scored.withColumns({c: F.col(c) * scale + float(np.log(p)) for c, p in zip(sums, model.prior)})
    most = F.greatest(*sums) if len(sums) > 1 else F.col(sums[0])
    scored = scored.withColumns({c: F.exp(F.col(c) - most) for c in sums})
    total = sum((F.col(c) for c in sums), F.lit(0.0))
    return scored.withColumns({name: F.col(c) / total for c, name in zip(sums, names)}).drop(*sums)


def shares(members: DataFrame, domains: list[str]) -> dict[str, float]:
    """The share of all tokens that each domain is expected to have; even shares where there are no tokens."""
    got = members.agg(F.sum("n_tokens"), *(F.sum(F.col("n_tokens") * F.col(f"p_{d}")) for d in domains)).first()
    return {d: float(x) / float(got[0]) if got[0] else 1 / len(domains) for d, x in zip(domains, got[1:])}


@dataclass
class Rates:
    """What fit_rates found: the shares of the expected tokens, how far the farthest is from its target, and l."""

    shares: dict[str, float]
    gap: float
    rounds: int
    slope: list[float]
    min_rate: float

    def of(self, members: DataFrame) -> Column:
        rate = 1 - sum((F.col(f"p_{d}") * x for d, x in zip(self.shares, self.slope)), F.lit(0.0))
        return F.when(F.col("n_tokens") > 0, F.greatest(F.lit(self.min_rate), rate)).otherwise(F.lit(max(1.0, self.min_rate)))


def find_rates(members: DataFrame, targets: dict[str, float], growth: float = 1.0, min_rate: float = 0.0, ridge: float = 1e-6, most_gap: float | None = 0.005, rounds: int = 60) -> Rates:
    """Rates for members (n_tokens and p_<domain> for each domain of targets).

    The expected token total of each domain, sum of rate * n_tokens * p, comes as near as it can to growth * all tokens
    * its target; targets are scaled to sum to 1. If a share of the expected tokens misses its target by over most_gap
    that is an error, unless most_gap is None. An empty table needs no rates. `members` is read once a round, so it
    should be a written table.
    """
    names = [f"p_{d}" for d in targets]
    t = np.array(list(targets.values()), float)
    if t.sum() <= 0 or (t < 0).any():
        raise ValueError("targets must not be negative, and one must be above 0")
    t /= t.sum()
    d = len(names)
    cells = [(i, j) for i in range(d) for j in range(i, d)]
    total = float(members.agg(F.sum("n_tokens")).first()[0] or 0)
    if not total:
        return Rates(dict.fromkeys(targets, 0.0), 0.0, 0, [0.0] * d, min_rate)

    whole = ridge * np.eye(d)

    def at(l: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """At the rates of l: the height of the dual problem, its gradient, sum of w p r, sum of w p p' off the bound."""
        fall = sum((F.col(c) * float(x) for c, x in zip(names, l)), F.lit(0.0))
        rate, w = F.greatest(F.lit(float(min_rate)), 1 - fall), F.col("n_tokens")
        free = w * (1 - fall >= min_rate).cast("double")
        height = F.sum(w * (F.pow(rate - 1, F.lit(2.0)) / 2 + fall * rate))
        got = members.agg(height, *(F.sum(F.col(c) * w * rate) for c in names), *(F.sum(F.col(names[i]) * F.col(names[j]) * free) for i, j in cells)).first()
        tokens, m = np.array(got[1 : 1 + d], float) / total, np.zeros((d, d))
        for (i, j), x in zip(cells, got[1 + d :]):
            m[i, j] = m[j, i] = x / total
        pull = ridge * whole @ l
        return got[0] / total - growth * t @ l - pull @ l / 2, tokens - growth * t - pull, tokens, m

    sums = members.agg(*(F.sum(F.col(names[i]) * F.col(names[j]) * F.col("n_tokens")) for i, j in cells)).first()
    for (i, j), x in zip(cells, sums):
        whole[i, j] = whole[j, i] = x / total + ridge * (i == j)
    l, k, damp = np.zeros(d), 1, 0.0
    height, slope, tokens, curve = at(l)
    while np.abs(slope).max() > 1e-7 and k < rounds:
        ahead = l + np.linalg.solve(curve + (ridge + damp) * whole, slope)
        found = at(ahead)
        k += 1
        if found[0] >= height:
            l, (height, slope, tokens, curve), damp = ahead, found, damp / 10 if damp > 1e-6 else 0.0
        elif damp >= 1:  # such a step cannot fall but by rounding
            break
        else:
            damp = min(1.0, max(1e-4, damp * 10))
    shares = tokens / tokens.sum()
    gap = float(np.abs(shares - t).max())
    if most_gap is not None and gap > most_gap:
        raise RuntimeError(f"after {k} rounds a domain's share misses its target by {gap:.4f}: {dict(zip(targets, shares.tolist()))}")
    return Rates(dict(zip(targets, shares.tolist())), gap, k, l.tolist(), float(min_rate))


def fit_rates(members: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """members with `rate`, as find_rates has it: how often each document is to be used, min_rate at least.

    Documents without words get max(1, min_rate). An empty table gives no rows.
    """
    return members.withColumn("rate", find_rates(members, targets, **options).of(members))


def copies(rate: Column, *key: Column) -> Column:
    """How many times a row is used: the whole part of its rate, and once more with a chance of the rest, by hash of key."""
    chance = F.pmod(F.xxhash64(*key, F.lit("copies")), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")
