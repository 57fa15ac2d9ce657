"""Language identification with averaged hashed subword embeddings.

A text is the bag of its byte n-grams, taken inside words marked at both ends and hashed
to a fixed number of buckets.  Each bucket has an embedding; a text's vector is the mean
of its embeddings, and a linear softmax over it gives the languages.  Training is
stochastic gradient descent in numpy on a bounded sample of labelled rows; the softmax
temperature and the rejection threshold are set on rows that training did not see.

Rejection has two grounds, both calibrated on those rows: the softmax is unsure, or the text
holds more n-grams that training never saw than texts of the learned languages do.  The second
catches what the softmax is sure of without reason: other languages, code, random letters.

Embeddings enter the softmax linearly, so for prediction the product of embedding and
softmax weights is kept for each bucket: a few numbers, broadcast with a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.bytescan import mix, slices, text_buffers

UNDETERMINED = "und"
#: Bytes kept in n-grams: ASCII letters, and any byte of a character outside ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)
_FOLD[65:91] += 32
_U = np.uint64


#: Bytes of text that are looked at together.
SLICE = 1 << 18
#: Slots of the record of n-grams of 4 bytes that training saw.
SEEN = 1 << 20


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each n-gram and the index of its text, for n-grams of 2, 3 and 4 bytes, and the
    slots of those of 4 bytes, which come last.

    Anything but letters separates words and counts as one blank; an n-gram holds a blank
    at its ends only.
    """
    folded = _FOLD[data].astype(np.uint32)
    if len(data) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    blank = folded == 32
    out, own = [], []
    packed = folded
    for n in (2, 3, 4):
        packed = (packed[:-1] << np.uint32(8)) | folded[n - 1 :]
        good = owner[: len(packed)] == owner[n - 1 :]
        for j in range(1, n - 1):
            good &= ~blank[j : j + len(packed)]
        good &= ~(blank[: len(packed)] & blank[n - 1 :]) if n == 2 else True
        at = np.flatnonzero(good)
        hashed = (packed[at].astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(n)) * _U(0xC2B2AE3D27D4EB4F)
        out.append((hashed >> _U(40)).astype(np.int64) & (buckets - 1))
        own.append(owner[at])
    return np.concatenate(out), np.concatenate(own), (hashed >> _U(44)).astype(np.int64)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; only texts without an ASCII letter are decoded."""

    def any_of(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[offsets[1:]] > total[offsets[:-1]]

    found = any_of(_LETTER[data] & (data < 128))
    for i in np.flatnonzero(~found & any_of(data > 127)).tolist():
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore"))
    return found


def strangeness(unseen: np.ndarray, count: np.ndarray, share: float, spread: float) -> np.ndarray:
    """By how many standard errors the share of unseen n-grams exceeds the usual one."""
    count = np.maximum(count, 1)
    return (unseen / count - share) / np.sqrt(share * (1 - share) / count + spread)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float
    seen: np.ndarray  # slots of the n-grams of 4 bytes that training saw
    unseen: tuple[float, float]  # usual share of others, and its variance between texts
    limit: float  # a text that is stranger is rejected

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Softmax probabilities of each text, whether it has a letter, and whether it is rejected."""
        n = len(offsets) - 1
        grams, owner, slots = ngram_buckets(data, offsets, len(self.table))
        count = np.bincount(owner, minlength=n).astype(float)
        logits = np.empty((n, len(self.languages)))
        for k in range(len(self.languages)):
            logits[:, k] = np.bincount(owner, weights=self.table[grams, k], minlength=n)
        logits = logits / np.maximum(count, 1)[:, None] + self.bias
        logits /= self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        last = owner[len(owner) - len(slots) :]
        strange = strangeness(np.bincount(last[~self.seen[slots]], minlength=n), np.bincount(last, minlength=n), *self.unseen)
        letters = has_letter(data, offsets)
        return p, letters, ~letters | (p.max(axis=1) < self.threshold) | (strange > self.limit)


def train(texts: list[str], langs: list[str], buckets: int = 1 << 16, dims: int = 16, epochs: int = 12, rate: float = 4.0, reject: float = 0.002, seed: int = 7) -> LanguageModel | None:
    """Fits the model; a fifth of the rows sets the temperature, the threshold and the limit.

    ``reject`` is the share of rightly predicted calibration rows that may fall on the wrong
    side of each; the threshold is never above 0.5, and the limit a quarter above its quantile
    and no less than 4.  Returns None without a labelled text.
    """
    languages = sorted(set(langs))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    rows = rng.permutation(len(texts))
    held = rows[: len(rows) // 5]
    label = np.array([languages.index(x) for x in langs])
    bags, slots = [], []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        grams, _, fours = ngram_buckets(raw, np.array([0, len(raw)]), buckets)
        b, c = np.unique(grams, return_counts=True)
        bags.append((b, c / max(c.sum(), 1)))
        slots.append(fours)
    emb = rng.normal(0, 1 / dims, (buckets, dims))
    out = np.zeros((dims, len(languages)))
    bias = np.zeros(len(languages))
    fit = rows[len(held) :] if len(rows) > 20 * len(languages) else rows
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            b, w = bags[i]
            if not len(b):
                continue
            h = w @ emb[b]
            z = h @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[label[i]] -= 1
            back = out @ g
            out -= step * 0.25 * np.outer(h, g)
            bias -= step * 0.002 * g
            emb[b] -= step * 4 * w[:, None] * back
    table = emb @ out
    check = held if len(held) >= 20 else fit
    z = np.array([(bags[i][1] @ table[bags[i][0]] if len(bags[i][0]) else np.zeros(len(languages))) + bias for i in check])
    want = label[check]

    def softmax(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = np.geomspace(1e-3, 10, 120)
    temperature = float(min(grid, key=lambda t: -np.log(np.maximum(softmax(t)[np.arange(len(want)), want], 1e-12)).mean()))
    p = softmax(temperature)
    good = p.argmax(axis=1) == want
    right = p.max(axis=1)[good]
    threshold = float(min(0.5, np.quantile(right, reject) * 0.9)) if len(right) else 0.0

    seen = np.zeros(SEEN, bool)
    for i in fit:
        seen[slots[i]] = True
    count = np.array([len(slots[i]) for i in check], float)
    unseen = np.array([(~seen[slots[i]]).sum() for i in check], float)
    share = float(np.clip((unseen.sum() + 1) / (count.sum() + 2), 1e-4, 0.5))
    long = count >= 100
    excess = (unseen[long] / count[long] - share) ** 2 - share * (1 - share) / count[long] if long.any() else np.zeros(1)
    usual = (share, float(max(excess.mean(), 1e-5)))
    strange = strangeness(unseen, count, *usual)[good]
    limit = float(max(4.0, np.quantile(strange, 1 - reject) * 1.25)) if len(strange) else np.inf
    return LanguageModel(languages, table, bias, temperature, threshold, seen, usual, limit)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: Column | None = None, per_language: int = 400, max_languages: int = 500) -> LanguageModel | None:
    """Trains on about ``per_language`` whole texts of each language, picked by a hash of the id.

    ``per_language`` and ``max_languages`` (the most frequent ones) bound what the driver
    reads; all else covers every row.  ``sample`` restricts the rows that may be used.  Rows
    whose text or language is null are left out; of languages as frequent as each other the
    first in alphabetical order come first.  Null ids share one hash, and repeated rows count
    as often as they occur.  Without a labelled row there is no model (None).
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if sample is not None:
        known = known.where(sample)
    counts = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    if not counts:
        return None
    share = F.coalesce(*[F.when(F.col(lang_col) == r["lang"], F.lit(min(1.0, per_language / r["n"]))) for r in counts], F.lit(0.0))
    at = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(at < share).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).collect()
    picked.sort(key=lambda r: (str(r["id"]), r["text"]))
    return train([r["text"] for r in picked], [str(r["lang"]) for r in picked])


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every row: ``id_col``, ``lang_pred``, ``score``, ``rejected``.

    ``score`` is the calibrated probability of ``lang_pred``.  Null text, or text without
    a letter, is ``und`` with score 0 and rejected.  Other rows keep the likeliest
    language and are rejected if the score is below the model's threshold, or if the text
    is stranger than its limit; of equal scores the language first in alphabetical order is
    given.  Without a model every row is ``und``.  Null ids get rows like any other, repeated
    rows equal results, an empty table an empty one; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "text", SLICE):
            n = batch.num_rows
            lang, score, rejected = [UNDETERMINED] * n, np.zeros(n), np.ones(n, bool)
            if model is not None:
                p, letters, rejected = model.scores(*text_buffers(batch.column(1)))
                best = p.argmax(axis=1)
                score = np.where(letters, p[np.arange(n), best], 0.0)
                lang = [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(lang), pa.array(score), pa.array(rejected)], names=["id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")
    return found.select(F.col("id").alias(id_col), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose language the model does not reject.

    Rows whose text is null, empty or without a letter are dropped; without a model all are.
    Repeated rows stay or go together, ids and other columns do not matter, and an empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text_col, SLICE):
            if model is None:
                continue
            rejected = model.scores(*text_buffers(batch.column(batch.schema.get_field_index(text_col))))[2]
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
