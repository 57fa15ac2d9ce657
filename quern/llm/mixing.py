"""Mixing documents to target domain weights with soft memberships.

A labelled table gives the domains of some documents.  A multinomial naive Bayes model
over hashed words, counted by grouped aggregation, turns every text into posteriors over
the domains.  Projected-gradient least squares then fits a nonnegative rate for each
document, so that the expected tokens of each domain, the sum of rate x tokens x
posterior, match the targets.

Each step is one aggregation to a few numbers for each pair of domains.  Gradients add up to
one vector before they are projected, so a rate is a function of the document's own posterior
and of that vector: an expression of one size at any step, never a table that is written and
rejoined.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_BYTES, stored

#: Word weights are kept for this many hash buckets, so the model has a fixed size.
BUCKETS = 4096
#: Default share of the mixed tokens for each domain (quality x toxicity).
TARGETS = {"good": 0.70, "poor": 0.25, "good-toxic": 0.03, "poor-toxic": 0.02}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the labels table; rows with a null are left out."""
    name = F.concat(F.when(F.col("quality") == 1, "good").otherwise("poor"), F.when(F.col("toxic") == 1, "-toxic").otherwise(""))
    return labels.where("quality is not null and toxic is not null and doc_id is not null").select("doc_id", name.alias("domain")).distinct()


def bags(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_tokens, buckets): how many words, and which hash buckets they fall in.

    A document counts a bucket once, so a long text does not outweigh the others.
    """
    words = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+")
    words = docs.select(F.col(id_col).alias("id"), F.filter(words, lambda w: w != "").alias("words"))
    return words.select("id", F.size("words").cast("long").alias("n_tokens"), F.array_distinct(F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))).alias("buckets"))


def word_weights(bags: DataFrame, domains: DataFrame, names: list[str], pooled: float = 10.0) -> tuple[list[list[float]], list[float]]:
    """log P(bucket | domain) / P(bucket) as BUCKETS x domains, and log P(domain).

    Counted over all labelled documents; collects BUCKETS x domains numbers, a fixed size.
    ``pooled`` documents of the corpus's own rates are added to each domain, so a domain
    with few labels says little.
    """
    known = domains.where(F.col("domain").isin(names)).select(F.col("doc_id").alias("id"), "domain")
    rows = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(rows.values()) * 120 <= BROADCAST_BYTES:
        known = F.broadcast(known)
    seen = bags.select("id", "buckets").join(known, "id").select("domain", F.explode("buckets").alias("bucket"))
    counts = {(r["domain"], r["bucket"]): r["n"] for r in seen.groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [sum(counts.get((d, b), 0) for b in range(BUCKETS)) for d in names]
    every = sum(sizes) + BUCKETS
    extra = pooled * every / max(sum(rows.values()), 1)
    weights = []
    for b in range(BUCKETS):
        share = (sum(counts.get((d, b), 0) for d in names) + 1) / every
        weights.append([math.log((counts.get((d, b), 0) + extra * share) / (size + extra) / share) for d, size in zip(names, sizes, strict=True)])
    total = sum(rows.values()) + len(names)
    return weights, [math.log((rows.get(d, 0) + 1) / total) for d in names]


def posteriors(docs: DataFrame, domains: DataFrame, names: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, n_tokens, p): p holds the posterior of each of ``names``, in that order.

    The log odds of a document are the mean evidence of its buckets times the root of
    their number, so that long texts do not become certain by length alone.
    """
    rows = stored(bags(docs, id_col, text_col), "bags").withColumn("row", F.monotonically_increasing_id())
    weights, prior = word_weights(rows, domains, names)
    model = [(b, *ws) for b, ws in enumerate(weights)]
    values = ",".join("(" + ",".join([str(b), *(f"{w!r}D" for w in ws)]) + ")" for b, *ws in model)
    model = docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(bucket, {', '.join(f'w{k}' for k in range(len(names)))})")
    each = rows.select("row", "id", "n_tokens", F.explode_outer("buckets").alias("bucket")).join(F.broadcast(model), "bucket", "left")
    sums = [(F.lit(prior[k]) + F.coalesce(F.sum(f"w{k}"), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias(f"s{k}") for k in range(len(names))]
    scored = each.groupBy("row", "id", "n_tokens").agg(*sums)
    top = F.greatest(*[F.col(f"s{k}") for k in range(len(names))]) if len(names) > 1 else F.col("s0")
    scored = scored.select("id", "n_tokens", *[F.exp(F.col(f"s{k}") - top).alias(f"e{k}") for k in range(len(names))])
    total = sum((F.col(f"e{k}") for k in range(1, len(names))), F.col("e0"))
    return scored.select("id", "n_tokens", F.array(*[F.col(f"e{k}") / total for k in range(len(names))]).alias("p"))


def solve_rates(p: DataFrame, targets: list[float], steps: int = 200, tolerance: float = 1e-6) -> tuple[Column, dict]:
    """Rates by projected gradient on |s - t|, s the attained and t the target shares.

    ``p`` has n_tokens and p.  Starts at rate 1 and projects lazily: preconditioned gradients
    add up to one vector, and a rate is max(0, 1 - p . vector).  A step is Newton's on
    |s - t|^2 + weight x the token-weighted square distance of the rates from 1, halved until
    it descends; the weight goes to 0.  Each step, a halved one too, is one aggregation.

    For any vector z with z . p >= 0 for all documents, no rates come closer to t than
    -z . t / |z|.  Stops when each share is within ``tolerance`` of its target, or when |s - t|
    is within ``tolerance`` of the best such bound, or after ``steps`` steps.  Returns the rate
    as a column over ``p``, and a report: ``tokens`` by domain, ``gap`` (|s - t|),
    ``least_gap`` (what no rates go below), ``steps`` and ``stopped`` (met, optimal or steps).
    """
    k, goal = len(targets), np.array(targets)
    at = lambda j: F.get(F.col("p"), F.lit(j))
    used = p.where("n_tokens > 0")

    def look(z: np.ndarray) -> dict:
        # An array that is indexed by a column stays data: no step compiles new code.
        raw = sum((at(j) * F.get(F.array(*map(F.lit, map(float, -z))), F.size("p") - (k - j)) for j in range(k)), F.lit(1.0))
        rows = used.select("p", "n_tokens", raw.alias("raw"), F.greatest(F.lit(0.0), raw).alias("rate"))
        on = F.when(F.col("raw") > 0, F.col("n_tokens")).otherwise(0)
        terms = [F.sum(F.col("n_tokens")), F.max("raw"), F.sum(F.col("n_tokens") * F.col("rate") * F.col("rate"))]
        terms += [F.sum(F.col("n_tokens") * F.col("rate") * at(j)) for j in range(k)] + [F.sum(on * at(i) * at(j)) for i in range(k) for j in range(i, k)]
        row = [float(x or 0.0) for x in rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(terms)]).first()]
        moment = np.zeros((k, k))
        moment[np.triu_indices(k)] = row[3 + k :]
        return {"total": row[0], "top": row[1], "square": row[2], "tokens": np.array(row[3 : 3 + k]), "moment": moment + np.triu(moment, 1).T}

    z, weight, least, turn, stopped = np.zeros(k), 1e-2, 0.0, 0, "steps"
    best, seen = (math.inf, z, np.zeros(k)), look(z)
    total = seen["total"] or 1.0
    trial, step, base = z, 1.0, None
    while True:
        shares = seen["tokens"] / total
        gap = float(np.linalg.norm(shares - goal))
        if gap < best[0]:
            best = (gap, trial, seen["tokens"])
        # The least p . z is 1 - the top rate; as p sums to 1, taking it off z makes z . p >= 0.
        apart = trial - min(1.0 - seen["top"], 0.0)
        if apart.any():
            least = max(least, float(-apart @ goal / np.linalg.norm(apart)))
        met = np.abs(shares - goal).max() <= tolerance
        if not seen["total"] or met or best[0] - least <= tolerance or turn == steps:
            if met:
                best = (gap, trial, seen["tokens"])
            stopped = "met" if met else "optimal" if best[0] - least <= tolerance else "steps"
            break
        value = seen["square"] / total / 2 + trial @ goal + weight / 2 * trial @ trial
        slope = shares - goal - weight * trial
        near = base is not None and np.linalg.norm(slope) <= 0.9 * base[1]
        if base is not None and value > base[0] and not near and step > 1e-6:
            step /= 2
        else:
            z, step = trial, 1.0
            while np.linalg.norm(slope) <= 0.1 * weight * np.linalg.norm(z) and weight > 1e-15:
                weight /= 10
                slope = shares - goal - weight * z
            base = (seen["square"] / total / 2 + z @ goal + weight / 2 * z @ z, np.linalg.norm(slope))
            move = np.linalg.solve(seen["moment"] / total + np.eye(k) * weight, slope)
        trial = z + step * move
        seen, turn = look(trial), turn + 1
    gap, z, tokens = best
    rate = F.greatest(F.lit(0.0), sum((at(j) * F.lit(float(-z[j])) for j in range(k)), F.lit(1.0)))
    return rate, {"tokens": tokens.tolist(), "gap": gap, "least_gap": least, "steps": turn, "stopped": stopped}


def fit_rates(p: DataFrame, targets: list[float], steps: int = 200, tolerance: float = 1e-6) -> tuple[Column, list[float]]:
    """The rate of ``solve_rates`` as a column over ``p``, and the expected tokens by domain."""
    rate, report = solve_rates(p, targets, steps, tolerance)
    return rate, report["tokens"]


def mix(
    docs: DataFrame,
    domains: DataFrame,
    targets: Mapping[str, float] = TARGETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    steps: int = 200,
) -> DataFrame:
    """A nonnegative rate for each document, so that domains reach their target tokens.

    ``domains`` (doc_id, domain) labels some documents (labels of a domain that ``targets`` does
    not name are left out); ``targets`` names the domains and their shares of the corpus's tokens (made to sum to 1).  Returns one row per input
    row: ``id_col``, ``n_tokens``, ``domain`` (the likeliest), ``posterior`` (one double
    for each domain, in the order of ``targets``), ``rate`` and ``mixed_tokens``
    (rate x n_tokens).  Where no rates meet the targets, they come as close as any can; the
    metadata of ``rate`` hold the report of ``solve_rates``, which tells how close.

    Null or empty text has no tokens and gets the prior as posterior.  With no labels
    the posteriors are flat.  A null id is labelled by nothing but still gets a row;
    repeated rows get equal results.  An empty table gives an empty result.  Of equal
    posteriors the domain named first in ``targets`` is given.
    """
    names = list(targets)
    share = sum(targets.values())
    p = stored(posteriors(docs, domains, names, id_col, text_col), "posteriors")
    rate, report = solve_rates(p, [targets[d] / share for d in names], steps)
    best = F.get(F.array(*[F.lit(d) for d in names]), F.array_position("p", F.array_max("p")).cast("int") - 1)
    return p.select(
        F.col("id").alias(id_col), "n_tokens", best.alias("domain"), F.col("p").alias("posterior"), rate.alias("rate", metadata=report), (rate * F.col("n_tokens")).alias("mixed_tokens")
    )
