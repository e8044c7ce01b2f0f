"""Mixing sources to target weights by soft membership.

A multinomial naive Bayes classifier over hashed words is fitted on the documents that a labelled table covers, with
the tag that they carry (`domain`, the language by default) as the class. Every document gets posteriors over the
domains; a document of n words weighs like n * evidence / (n + evidence) of them, at every length, so that memberships
stay soft. Projected-gradient least squares then fits nonnegative document rates whose expected domain token totals match
the targets:

    minimise 1/2 sum_d (sum_i r_i n_i p_id - t_d)^2 / N_d   over r >= 0, starting from r = 1,

in the metric that weighs a document by its tokens. A step is r_i <- max(0, r_i - sum_d p_id (E_d - t_d) / N_d), so a
rate depends on a document's posteriors and on one residual vector per step; the step length of 1 is right because
the curvature in that metric is at most 1. Each step is one aggregation to as many numbers as there are domains. All
of it is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, materialize, words

SLOTS, SAMPLE, EVIDENCE, STEPS, TOLERANCE = 2048, 4000, 25, 60, 1e-6
#: Domains that a tag may have; more are an error, since targets name each of them.
DOMAINS = 64


def _slot(w: Column) -> Column:
    return F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int")


def _constant(values: list[float]) -> Column:
    """A literal array, folded once when the query is planned."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def classifier(docs: DataFrame, labels: DataFrame, domain: str = "lang", sample: int = SAMPLE) -> tuple[list[str], list[float], list[list[float]]]:
    """Domains in order, their log priors, and log probabilities of the word slots, from at most `sample` labelled documents."""
    known = bounded_sample(labels.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), sample, "doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(domain).cast("string").alias("domain"), F.col("text").cast("string").alias("text")).where("domain is not null")
    rows = rows.join(F.broadcast(known), "doc_id")  # at most `sample` numbers
    slots = rows.select("domain", F.explode(F.transform(words(F.col("text")), _slot)).alias("slot")).groupBy("domain", "slot").agg(F.count("*").alias("n")).collect()
    names = sorted({r["domain"] for r in slots})
    if len(names) > DOMAINS:
        raise ValueError(f"{domain} has more than {DOMAINS} values; name targets for fewer domains")
    table = {d: [0.5] * SLOTS for d in names}
    for r in slots:
        table[r["domain"]][r["slot"]] += r["n"]
    total = {d: sum(table[d]) for d in names}
    every = sum(total.values())
    return names, [math.log(total[d] / every) for d in names], [[math.log(x / total[d]) for x in table[d]] for d in names]


def posteriors(docs: DataFrame, names: list[str], prior: list[float], table: list[list[float]], evidence: int = EVIDENCE) -> DataFrame:
    """Adds n_tokens (words) and p0, p1, ... to docs; without any domain, p0 is 1."""
    slots = F.transform(words(F.col("text").cast("string")), _slot)
    d = docs.withColumn("__slots", slots).withColumn("n_tokens", F.size("__slots").cast("long"))
    if not names:
        return d.drop("__slots").withColumn("p0", F.lit(1.0))
    soft = F.lit(evidence) / (F.col("n_tokens") + evidence)
    for k, row in enumerate(table):
        logs = _constant(row)
        d = d.withColumn(f"__z{k}", F.lit(prior[k]) + soft * F.aggregate("__slots", F.lit(0.0), lambda s, x: s + F.get(logs, x)))
    best = F.greatest(*(F.col(f"__z{k}") for k in range(len(names)))) if len(names) > 1 else F.col("__z0")
    d = d.withColumn("__best", best)
    e = [F.exp(F.col(f"__z{k}") - F.col("__best")) for k in range(len(names))]
    d = d.withColumns({f"__e{k}": x for k, x in enumerate(e)})
    total = sum((F.col(f"__e{k}") for k in range(1, len(names))), F.col("__e0"))
    d = d.withColumns({f"p{k}": F.col(f"__e{k}") / total for k in range(len(names))})
    return d.drop("__slots", "__best", *(f"__z{k}" for k in range(len(names))), *(f"__e{k}" for k in range(len(names))))


def rate(history: list[list[float]]) -> Column:
    """The rate after the steps whose scaled residuals `history` holds."""
    r = F.lit(1.0)
    for res in history:
        r = F.greatest(F.lit(0.0), r - sum((F.lit(v) * F.col(f"p{k}") for k, v in enumerate(res)), F.lit(0.0)))
    return r


def fit_rates(members: DataFrame, names: list[str], targets: dict[str, float] | None, temper: float = 0.7, steps: int = STEPS) -> list[list[float]]:
    """The scaled residuals of each step. targets: shares by domain; None: the domains' own shares to the power `temper`."""
    k = max(1, len(names))
    sums = lambda weight: [F.sum(weight * F.col("n_tokens") * F.col(f"p{d}")).alias(f"e{d}") for d in range(k)]
    now = [float(x or 0.0) for x in members.agg(*sums(F.lit(1.0))).first()]
    total = sum(now)
    if total <= 0:
        return []
    share = [(targets.get(n, 0.0) if targets is not None else (x / total) ** temper) for n, x in zip(names or [""], now)]
    if sum(share) <= 0 or min(share) < 0:
        raise ValueError("target weights must be nonnegative and not all zero")
    goal = [s / sum(share) * total for s in share]
    scale = [max(x, 1e-9 * total) for x in now]
    history: list[list[float]] = []
    for _ in range(steps):
        # Rounded, so that the order of the sums does not reach the rates.
        res = [float(f"{(e - t) / s:.10g}") for e, t, s in zip(now, goal, scale)]
        if max(abs(v) for v in res) < TOLERANCE:
            break
        history.append(res)
        now = [float(x or 0.0) for x in members.agg(*sums(rate(history))).first()]
    return history


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: str = "lang", carry: list[str] | None = None, **fit) -> DataFrame:
    """Rates and whole numbers of copies for all documents.

    docs: doc_id long, text string and the tag `domain`; labels: doc_id long; other columns are ignored unless carried.
    Returns doc_id (or the columns to carry), n_tokens, posteriors (in the order of the sorted domains), rate and
    copies: the rate rounded down, and one more with the probability of its fraction, drawn by a hash of doc_id and
    the text's length. Null and empty texts have no tokens and the prior as posteriors. Documents with a null tag are
    not learnt from but mixed; rows with a null doc_id are mixed too. Repeated rows get the same rate and copies.
    Without labelled documents all rates are 1. An empty table gives an empty result.
    """
    carry = carry or ["doc_id"]
    names, prior, table = classifier(docs, labels, domain, **fit)
    view = docs.select(*(F.col(c).alias(f"__c{k}") for k, c in enumerate(carry)), F.col("doc_id").alias("__id"), F.col("text"))
    k = max(1, len(names))
    members = posteriors(view, names, prior, table)
    slim = materialize(members.select("__id", F.length("text").alias("__size"), *(f"__c{i}" for i in range(len(carry))), "n_tokens", *(f"p{d}" for d in range(k))), "mix-members")
    history = fit_rates(slim, names, targets)
    u = F.pmod(F.xxhash64("__id", "__size", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = slim.withColumn("rate", rate(history)).withColumn("copies", (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))
    return out.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)), "n_tokens", F.array(*(F.col(f"p{d}") for d in range(k))).alias("posteriors"), "rate", "copies")
