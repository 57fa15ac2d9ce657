"""Quality and toxicity of documents by hierarchical empirical Bayes.

A document classifier, logistic regression over hashed words trained on a bounded sample
of the labelled rows, gives each document's own evidence.  Evidence of all documents is
then pooled by grouped aggregation: a site (host) has a beta posterior whose prior is the
corpus mean, a path under it has one whose prior is its site, and the strength of each
prior is estimated from the spread between groups by the method of moments, so sparse
sites and paths shrink toward what lies above them.  A document's final log odds are its
own evidence plus what the other documents of its path and site say beyond the corpus.

Toxicity is a matter of the document itself, so its score takes the classifier alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.bytescan import mix, slices, text_buffers
from quern.llm.common import HOT_KEYS, stored

_U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BYTE = np.random.default_rng(991).integers(1, 2**63, 256, dtype=np.uint64)
SHAPES = 8
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_KIND[65:91], _KIND[48:58], _KIND[10], _KIND[128:] = 2, 3, 4, 5


def word_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words (letters and digits, A-Z lower-cased) and the index of their texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    counts = np.add.reduceat(inside, starts, dtype=np.int64)
    word_at = np.cumsum(counts) - counts
    place = np.arange(len(at), dtype=np.int64) - np.repeat(word_at, counts)
    powers = np.cumprod(np.full(int(counts.max()) + 1, _U(0x9E3779B97F4A7C15), dtype=np.uint64))
    hashes = mix(np.add.reduceat(_BYTE[_LOW[data[at]]] * powers[place], word_at) + counts.astype(np.uint64))
    return (hashes & _U(buckets - 1)).astype(np.int64), np.searchsorted(offsets, starts, side="right") - 1


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each text with the index of their text, and the text's shape:
    shares of kinds of bytes, length and variety of words."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    grams, owner = word_buckets(data, offsets, buckets)
    words = np.bincount(owner, minlength=n)
    pairs = np.sort(owner * buckets + grams)
    if len(pairs):
        pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))]
    owner, grams = pairs // buckets, pairs % buckets
    distinct = np.bincount(owner, minlength=n)

    def share(kind: int) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(_KIND[data] == kind, dtype=np.int64)))
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    shape = [share(1) * 5, share(2) * 5, share(3) * 5, share(4) * 20, share(5) * 2, distinct / np.maximum(words, 1), np.minimum(np.log1p(words) / 10, 2), np.minimum(words / size, 1) * 4]
    return grams, owner, np.stack(shape, axis=1)


@dataclass(frozen=True)
class Classifier:
    """log odds = bias + weights of the distinct buckets + shape weights; one column a label."""

    weights: np.ndarray
    shape_weights: np.ndarray
    bias: np.ndarray

    def log_odds(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        grams, owner, shape = features(data, offsets, len(self.weights))
        out = shape @ self.shape_weights + self.bias
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(owner, weights=self.weights[grams, k], minlength=n)
        return out


def train(texts: list[str], labels: np.ndarray, buckets: int = 1 << 20, epochs: int = 15, rate: float = 0.3, least_z: float = 5.0, seed: int = 3) -> Classifier:
    """Logistic regression for each column of ``labels`` by AdaGrad.

    Only buckets whose share of texts differs between the classes by ``least_z`` standard
    errors get a weight, so the many rare words of a long text cannot drown the few that
    matter.
    """
    k, n = labels.shape[1], len(texts)
    bags = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        grams, _, shape = features(raw, np.array([0, len(raw)]), buckets)
        bags.append((grams, shape[0]))
    w = np.zeros((buckets, k), np.float32)
    sw, bias = np.zeros((SHAPES, k)), np.zeros(k)
    share = np.clip(labels.mean(axis=0), 0.02, 0.98) if n else np.full(k, 0.5)
    bias += np.log(share / (1 - share))
    every = np.bincount(np.concatenate([b for b, _ in bags]), minlength=buckets) if n else np.zeros(buckets)
    chosen = np.zeros((buckets, k), bool)
    for j in range(k):
        n1 = labels[:, j].sum()
        if 0 < n1 < n:
            ones = np.bincount(np.concatenate([b for (b, _), y in zip(bags, labels[:, j], strict=True) if y]), minlength=buckets)
            p = every / n
            z = (ones / n1 - (every - ones) / (n - n1)) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / (n - n1)))
            chosen[:, j] = (np.abs(z) >= least_z) & (every >= 5)
    rows = [(b[chosen[b].any(axis=1)], x) for b, x in bags]
    gw, gs, gb = np.full((buckets, k), 1e-2, np.float32), np.full((SHAPES, k), 1e-2), np.full(k, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(n):
            b, x = rows[i]
            z = bias + x @ sw + w[b].sum(axis=0)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]
            gr = g * chosen[b]
            gw[b] += gr**2
            w[b] -= rate * gr / np.sqrt(gw[b])
            go = np.outer(x, g)
            gs += go**2
            sw -= rate * 0.3 * go / np.sqrt(gs)
            gb += g**2
            bias -= rate * 0.3 * g / np.sqrt(gb)
    return Classifier(w, sw, bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 6000) -> Classifier:
    """Trains on about ``sample`` labelled rows, picked by a hash of the id.

    ``sample`` bounds what the driver reads.  Labels with a null are left out; without any
    label the classifier gives every text even odds.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", "quality", "toxic")
    n = known.count()
    at = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    known = known.where(at < min(1.0, sample / max(n, 1))).select(F.col("doc_id").alias("_label_id"), "quality", "toxic")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("id") == F.col("_label_id")).select("id", "text", "quality", "toxic").collect()
    rows.sort(key=lambda r: (r["id"], r["text"] or ""))
    return train([r["text"] or "" for r in rows], np.array([[r["quality"], r["toxic"]] for r in rows], float).reshape(-1, 2))


def _pooled(df: DataFrame, keys: list[str], mean: Column) -> DataFrame:
    """Sums of evidence by group; partial sums are taken before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("q").alias("sum_q"))


def strength(groups: DataFrame) -> float:
    """Prior strength (pseudo-documents) from the spread of group means, by moments."""
    row = groups.agg(
        F.sum("n").alias("n"), F.sum("sum_q").alias("s"), F.count(F.lit(1)).alias("g"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("sum_q") * F.col("sum_q") / F.col("n")).alias("between")
    ).first()
    if not row["g"] or row["g"] < 2:
        return 50.0
    mean = row["s"] / row["n"]
    within = max(mean * (1 - mean), 1e-6)
    spread = row["between"] - row["n"] * mean * mean - (row["g"] - 1) * within
    variance = spread / max(row["n"] - row["nn"] / row["n"], 1e-9)
    return float(min(max(within / variance - 1 if variance > 0 else 1e4, 1.0), 1e4))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, keep_at: float = 0.15, toxic_at: float = 0.5, classifier: Classifier | None = None) -> DataFrame:
    """Scores every document: ``id_col``, ``host``, ``path``, ``evidence`` (the classifier's
    probability of good quality), ``site_quality``, ``path_quality`` (posterior means),
    ``quality`` (own evidence and the posterior of the path without this document),
    ``toxic_score``, ``toxic``, ``kept``.

    ``host`` defaults to the column source, ``path`` to source/lang.  ``kept`` are the
    documents that are not toxic and whose ``quality`` is at least ``keep_at``.
    Null host or path are a group of their own, named "".  A document alone in its path or
    site has what lies above as its prior.  Equal scores are told apart by nothing.  Null or empty text is scored
    as an empty text.  Null ids get rows like any other; repeated rows get equal results
    and count as often as they occur.  Extra columns are ignored; an empty table gives an
    empty result.
    """
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.col("source"), F.col("lang")) if path is None else path
    classifier = classifier or fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            odds = np.clip(shared.value.log_odds(*text_buffers(batch.column(3))), -30, 30)
            q, t = 1 / (1 + np.exp(-odds[:, 0])), 1 / (1 + np.exp(-odds[:, 1]))
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(q), pa.array(t)], names=["id", "host", "path", "q", "t"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), F.col(text_col).alias("text"))
    seen = stored(rows.mapInArrow(run, f"id {kind}, host string, path string, q double, t double"), "evidence")

    paths = stored(seen.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("q").alias("sum_q")), "paths")
    sites = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("sum_q").alias("sum_q"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("sum_q").alias("s")).first()
    total = whole["n"] or 0.0
    mean = min(max((whole["s"] or 0.0) / total, 1e-6), 1 - 1e-6) if total else 0.5
    site_strength, path_strength = strength(sites), strength(paths)
    shrunk = lambda sum_q, n, prior, by: (sum_q + by * prior) / (n + by)
    sites = sites.select("host", F.col("n").alias("site_n"), F.col("sum_q").alias("site_sum"), shrunk(F.col("sum_q"), F.col("n"), F.lit(mean), site_strength).alias("site_quality"))
    paths = paths.join(sites, "host").withColumn("path_quality", shrunk(F.col("sum_q"), F.col("n"), F.col("site_quality"), path_strength))
    paths = stored(paths, "path_posteriors")
    # Paths with over 1/1024 of the rows, at most 1024 of them, join by broadcast.
    hot = F.broadcast(paths.where(F.col("n") > total / HOT_KEYS))
    cold = paths.where(F.col("n") <= total / HOT_KEYS)
    joined = seen.join(hot, ["host", "path"]).unionByName(seen.join(hot.select("host", "path"), ["host", "path"], "left_anti").join(cold, ["host", "path"]))
    logit = lambda p: F.log(p / (1 - p))
    bounded = lambda p: F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    # The prior of a document: the posterior of its path without the document itself.
    others = shrunk(F.col("site_sum") - F.col("q"), F.col("site_n") - 1, F.lit(mean), site_strength)
    others = shrunk(F.col("sum_q") - F.col("q"), F.col("n") - 1, others, path_strength)
    odds = logit(bounded(F.col("q"))) + logit(bounded(others)) - F.lit(float(np.log(mean / (1 - mean))))
    quality = 1 / (1 + F.exp(-odds))
    return joined.select(
        F.col("id").alias(id_col), "host", "path", F.col("q").alias("evidence"), "site_quality", "path_quality", quality.alias("quality"), F.col("t").alias("toxic_score"), (F.col("t") >= toxic_at).alias("toxic"),
        ((F.col("t") < toxic_at) & (quality >= keep_at)).alias("kept"),
    )
