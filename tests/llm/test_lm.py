import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import class_lm as L
from quern.llm.bytescan import text_buffers, words
from tests.llm.brute import base_scores, docs
from tests.llm.brute import words as plain_words

TEXTS = ["the cat sat", "The dog sat", "a cat ran", None, "", "the dog ran far", "unseen words here", "the the the", "x " * 500]


@pytest.mark.parametrize("held", [1 << 19, 3])
def test_base_scores_for_any_vocabulary(spark, held):
    df = docs(spark, TEXTS)
    train = [i % 3 != 0 for i in range(len(TEXTS))]
    got = {r["doc_id"]: r for r in L.score(df, F.col("doc_id") % 3 != 0, top_words=4, n_classes=2, vocabulary=held).collect()}
    for i, (n, known, total, score) in enumerate(base_scores(TEXTS, train)):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert abs(r["base_score"] - score) < 1e-9 and r["score"] < 0 and np.isfinite(r["score"])


def gain(table, of):
    n = of.max() + 1
    pairs = np.zeros((n, n))
    np.add.at(pairs, (of[:, None], of[None, :]), table)
    f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
    return f(pairs) - f(pairs.sum(axis=0)) - f(pairs.sum(axis=1))


def test_exchange_raises_the_likelihood(spark):
    rng = np.random.default_rng(0)
    kind = rng.integers(0, 3, 12)
    table = np.zeros((13, 13), int)
    for _ in range(6000):  # words of a kind are followed by those of the next
        a = rng.integers(0, 12)
        table[a, rng.choice(np.flatnonzero(kind == (kind[a] + 1) % 3))] += 1
    rows = [(a, b, int(table[a, b])) for a, b in zip(*np.nonzero(table), strict=True)]
    pairs = spark.createDataFrame([(int(a), int(b), n) for a, b, n in rows], "a long, b long, n long")
    of = L.exchange(pairs, 12, 1, 3)
    start, end, true = np.append(np.arange(12) % 3, 3), np.append(of, 3), np.append(kind, 3)
    assert gain(table, end) > gain(table, start)
    assert gain(table, end) - gain(table, start) > 0.9 * (gain(table, true) - gain(table, start))


def plain_scores(model, texts):
    """Scores by a model's classes, with all counts taken anew in plain Python."""
    learnt = [t for i, t in enumerate(texts) if i % 3]
    name = lambda w: int(words(*text_buffers(pa.array([w])))[0][0])
    of = {int(h): int(c) for h, c in zip(model.classes.hashes, model.classes.cls, strict=True)}
    tail, end = model.classes.tail, model.classes.tail + 1
    chain = lambda t: [of.get(name(w), tail) for w in plain_words(t)] + [end]
    pairs, counts = collections.Counter(), collections.Counter(name(w) for t in learnt for w in plain_words(t))
    for t in learnt:
        c = chain(t)
        pairs.update(zip([end, *c[:-1]], c, strict=True))
    size = end + 1
    inside = [sum(n for w, n in counts.items() if of.get(w, tail) == c) for c in range(size)]
    space = inside[tail] + sum(of.get(w, tail) == tail for w in counts) + 1
    out = []
    for t in texts:
        ws, c, total = [name(w) for w in plain_words(t)], chain(t), 0.0
        for i, here in enumerate(c):
            before = c[i - 1] if i else end
            row = sum(pairs[before, x] for x in range(size))
            total += math.log10((pairs[before, here] + 0.5) / (row + 0.5 * size))
            if here != end:
                total += math.log10((counts[ws[i]] + 1) / space if here == tail else counts[ws[i]] / inside[here])
        out.append(total)
    return out


@pytest.mark.parametrize("top,vocabulary", [(4, 1 << 19), (2, 6)])
def test_scores_match_plain_counts(spark, monkeypatch, top, vocabulary):
    texts = [*TEXTS, *(f"the {a} {b} in a {c}" for a in ("cat", "dog", "cow") for b in ("sat", "ran", "slept") for c in ("house", "field"))]
    models = []
    fit = L.fit
    monkeypatch.setattr(L, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    got = {r["doc_id"]: r["score"] for r in L.score(docs(spark, texts), F.col("doc_id") % 3 != 0, top_words=top, n_classes=3, vocabulary=vocabulary).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], plain_scores(models[0], texts))


def test_rest_of_the_vocabulary_joins_words_of_its_kind(spark):
    rng = np.random.default_rng(1)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    weight = 1 / (1 + np.arange(30.0))
    pick = lambda ws: str(rng.choice(ws, p=weight / weight.sum()))
    texts = [" ".join(x for _ in range(6) for x in (pick(nouns), pick(verbs))) for _ in range(400)]
    df = docs(spark, texts)
    vocab = L.word_counts(df)
    model = L.fit(df, vocab, 20, 2, 1 << 19, 0.5)
    of = dict(zip(model.classes.hashes.tolist(), model.classes.cls.tolist(), strict=True))
    kinds = [[of.get(int(words(*text_buffers(pa.array([w])))[0][0])) for w in ws] for ws in (nouns, verbs)]
    assert all(len({x for x in k if x is not None}) == 1 for k in kinds) and kinds[0][0] != kinds[1][0]


def test_floor_of_the_vocabulary(spark):
    counts = [1] * 40 + [2] * 7 + [20000] * 5 + [20001] * 3 + [10**12]
    vocab = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "h long, c long")
    for most in (0, 4, 8, 15, 17, 56):
        want = min((f for f in {1, *(c + 1 for c in counts)} if sum(c >= f for c in counts) <= most))
        assert sum(c >= L.count_floor(vocab, most) for c in counts) == sum(c >= want for c in counts)


def test_no_training_rows_and_empty(spark):
    df = docs(spark, TEXTS)
    assert L.score(df, F.lit(False)).where("n_known = 0 and base_score = 0").count() == len(TEXTS)
    assert L.score(df.limit(0), F.lit(True)).count() == 0


def test_probabilities_sum_to_one(spark, monkeypatch):
    """After any class, the chances of all words, of one unseen word and of the end add up to 1."""
    models = []
    fit = L.fit
    monkeypatch.setattr(L, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    texts = ["a b c", "b a d d", "a a e", "c b"]
    vocab = {w for t in texts for w in t.split()}
    df = docs(spark, texts).unionByName(docs(spark, ["", *sorted(vocab), "unseen"], range(100, 102 + len(vocab))))
    rows = {r["doc_id"]: r["score"] for r in L.score(df, F.col("doc_id") < 100, top_words=2, n_classes=2, vocabulary=3).collect()}
    follow, tail = models[0].follow, models[0].classes.tail
    assert np.allclose((10**follow).sum(axis=1), 1)
    known = dict(zip(models[0].classes.hashes.tolist(), models[0].classes.cls.tolist(), strict=True))
    first = 10 ** rows[100]  # the end at once
    for i, w in enumerate([*sorted(vocab), "unseen"]):
        cls = known.get(int(words(*text_buffers(pa.array([w])))[0][0]), tail)
        first += 10 ** (rows[101 + i] - follow[cls, tail + 1])
    assert abs(first - 1) < 1e-9
