"""Scoring texts by a Brown class-based bigram model.

Every token belongs to one class, and its probability is that of its class after the class
before it, times its share of the class:

    P(w | v) = P(class(w) | class(v)) * P(w | class(w))

Classes are found in two steps.  The ``top_words`` most frequent words are clustered by
exchange: each word moves to the class that raises the bigram likelihood most, and contexts
are counted anew between passes.  Each other word of the ``vocabulary`` is then put in the
class that makes its own tokens likeliest among their neighbours.  Words outside the
vocabulary, unseen ones included, are the tail class; the end of a text is a class of its own.
``top_words`` and ``vocabulary`` are parameters of the model, the same at every size of the
corpus, so what a text scores depends on them and on counts alone.

Counts are taken over the whole training part.  Words are known by 64-bit hashes, counted
in the executors and summed by key.  The vocabulary is broadcast; the tail's words of each
text are sent to the count table by a join on the word, so their number may outgrow any
machine.  Their class is known without that join, so transitions are scored in the same scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.bytescan import slices, text_buffers, words
from quern.llm.common import stored


@dataclass(frozen=True)
class Classes:
    """Sorted hashes of the broadcast words with their class and count."""

    hashes: np.ndarray
    cls: np.ndarray
    counts: np.ndarray
    tail: int  # class of every other word; end has class tail + 1

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and count of each word; the count is -1 for words that are not here."""
        if not len(self.hashes):
            return np.full(len(h), self.tail, np.int64), np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        here = self.hashes[at] == h
        return np.where(here, self.cls[at], self.tail).astype(np.int64), np.where(here, self.counts[at], -1)

    def chain(self, cls: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class before and class of every token, ends included, and the token's text."""
        n = len(bounds) - 1
        size = np.diff(bounds) + 1
        owner = np.repeat(np.arange(n), size)
        stop = np.cumsum(size) - 1
        here = np.full(len(owner), self.tail + 1, np.int64)
        inner = np.ones(len(owner), bool)
        inner[stop] = False
        here[inner] = cls[bounds[0] : bounds[-1]]
        before = np.empty_like(here)
        before[1:] = here[:-1]
        if n:
            before[stop - size + 1] = self.tail + 1
        return before, here, owner


def _summed(batches: Iterator[tuple[np.ndarray, np.ndarray]], flush: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts with equal keys added up, as far as ``flush`` keys in memory allow."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return keys, np.bincount(inverse, weights=np.concatenate([x for _, x in held]), minlength=len(keys)).astype(np.int64)

    for keys, counts in batches:
        held.append((keys, counts))
        if sum(len(x) for x, _ in held) > flush:
            held[:] = [merged()]
            if len(held[0][0]) > flush // 2:
                yield held.pop()
    if held:
        yield merged()


def _counted(rows: DataFrame, keys_of, flush: int = 1 << 18) -> DataFrame:
    """(key, n): how often ``keys_of`` (batch of texts -> keys) gives each key over ``rows.text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (np.unique(keys_of(batch), return_counts=True) for batch in slices(batches, "text"))
        for keys, counts in _summed(found, flush):
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])

    return rows.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def word_counts(rows: DataFrame, flush: int = 1 << 18) -> DataFrame:
    """(h, c): occurrences of every word of ``rows.text``, by its hash as a long."""
    counts = _counted(rows, lambda batch: words(*text_buffers(batch.column(0)))[0], flush)
    return counts.select(F.col("key").alias("h"), F.col("n").alias("c"))


def count_floor(vocab: DataFrame, most: int) -> int:
    """The least count that ``most`` words or fewer reach: words of one count go in or out together."""
    low, high = 1, int(vocab.agg(F.max("c")).first()[0] or 0) + 1  # high: a floor that surely will do
    above = 0  # words at or over high
    while low < high:
        width = -(-(high - low) // 256)
        bins = vocab.where((F.col("c") >= low) & (F.col("c") < high)).groupBy(F.floor((F.col("c") - low) / width).alias("bin")).agg(F.count(F.lit(1)).alias("v")).collect()
        found, start = {r["bin"]: r["v"] for r in bins}, low
        for k in range((high - low - 1) // width, -1, -1):
            if above + found.get(k, 0) > most:
                low, high = start + k * width, min(high, start + (k + 1) * width)
                break
            above += found.get(k, 0)
        else:
            return low
        if width == 1:
            return high
    return high


def bigram_counts(rows: DataFrame, classes: Classes) -> np.ndarray:
    """Dense counts of class pairs (before, here) over ``rows.text``; a fixed size."""
    k = classes.tail + 2
    shared = rows.sparkSession.sparkContext.broadcast(classes)

    def keys_of(batch: pa.RecordBatch) -> np.ndarray:
        h, _, bounds = words(*text_buffers(batch.column(0)))
        before, here, _ = shared.value.chain(shared.value.of(h)[0], bounds)
        return before * k + here

    found = _counted(rows, keys_of).toArrow()
    out = np.zeros(k * k, np.int64)
    out[found.column("key").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(k, k)


def contexts(pairs: DataFrame, of: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """For each unit, how often each class stands after it and before it; a fixed size.

    ``pairs``: a, b, n over units; ``of``: the class of each unit.
    """
    units = len(of)
    shared = pairs.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, out = shared.value, np.zeros(2 * units * total, np.int64)
        for batch in batches:
            a, b, n = (batch.column(i).to_numpy() for i in range(3))
            np.add.at(out, a * total + of[b], n)
            np.add.at(out, (units + b) * total + of[a], n)
        at = np.flatnonzero(out)
        yield pa.record_batch([pa.array(at), pa.array(out[at])], names=["key", "n"])

    found = pairs.select("a", "b", "n").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * units * total, np.int64)
    out[found.column("key").to_numpy()] = found.column("n").to_numpy()
    after, before = out.reshape(2, units, total)
    return after, before


def exchange_pass(of: np.ndarray, after: np.ndarray, before: np.ndarray, n_words: int, n_classes: int) -> int:
    """Moves words 0..n_words-1 between classes 0..n_classes-1 in turn, by contexts counted
    under the classes as they were; returns how many moved.

    A word goes to the class with the greatest sum of N log N over class pairs, less that over
    class margins.  Ties go to the lowest class.
    """
    total = after.shape[1]
    table = np.zeros((total, total))
    np.add.at(table, of, after.astype(float))
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-300))
    c, moved = np.arange(n_classes), 0
    for w in range(n_words):
        old, out_row, in_col = of[w], after[w].astype(float), before[w].astype(float)
        rest = table.copy()
        rest[old, :] -= out_row
        rest[:, old] -= in_col
        np.maximum(rest, 0, out=rest)  # contexts counted under older classes may take too much
        right, left = rest.sum(axis=1)[:n_classes], rest.sum(axis=0)[:n_classes]
        gain = (xlogx(rest[:n_classes] + out_row) - xlogx(rest[:n_classes])).sum(axis=1)
        gain += (xlogx(rest[:, :n_classes] + in_col[:, None]) - xlogx(rest[:, :n_classes])).sum(axis=0)
        gain -= xlogx(right + out_row.sum()) - xlogx(right) + xlogx(left + in_col.sum()) - xlogx(left)
        new = int(gain.argmax())
        if new != old and gain[new] > gain[old] + 1e-9 * abs(gain[old]):
            rest[new, :] += out_row
            rest[:, new] += in_col
            table, of[w], moved = rest, new, moved + 1
    return moved


def exchange(pairs: DataFrame, n_words: int, fixed: int, n_classes: int, passes: int = 4) -> np.ndarray:
    """Class of each word 0..n_words-1; ``fixed`` units after them keep classes of their own.

    Words start round robin by rank; contexts are counted anew for each pass, and passes end
    when no word moves or the likelihood no longer rises.
    """
    of = np.concatenate([np.arange(n_words) % n_classes, n_classes + np.arange(fixed)])
    total, best, kept = n_classes + fixed, -np.inf, of.copy()
    for turn in range(passes + 1):
        after, before = contexts(pairs, of, total)
        table = np.zeros((total, total))
        np.add.at(table, of, after.astype(float))
        value = sum(float((x * np.log(np.maximum(x, 1))).sum()) * sign for x, sign in ((table, 1), (table.sum(axis=0), -1), (table.sum(axis=1), -1)))
        if value <= best:
            break
        best, kept = value, of.copy()
        if turn == passes or not exchange_pass(of, after, before, n_words, n_classes):
            break
    return kept[:n_words]


def placed(rows: DataFrame, units: Classes, m: int, of: np.ndarray, gains: np.ndarray, default: int) -> np.ndarray:
    """Class of each vocabulary word from rank m on, by the classes around its tokens.

    ``units`` has a word's rank as its class.  ``gains`` (2 x classes, word classes) is what a
    neighbour of a class, before or after, adds to each word class.  Words of which no
    neighbour has a class yet go to ``default``; ties go to the lowest class.
    """
    rest, total = units.tail, len(gains) // 2
    # Classes of the neighbours: those of the top words, and of the end.
    known = np.full(rest + 2, -1)
    known[:m], known[rest + 1] = of, total - 1
    shared = rows.sparkSession.sparkContext.broadcast((units, known, gains))

    def keys_of(batch: pa.RecordBatch) -> np.ndarray:
        units, known, _ = shared.value
        h, _, bounds = words(*text_buffers(batch.column(0)))
        before, here, _ = units.chain(units.of(h)[0], bounds)
        ours = lambda u: (u >= m) & (u < rest)
        x = ours(here) & (known[before] >= 0)
        y = ours(before) & (known[here] >= 0)
        return np.concatenate((here[x] * 2 * total + known[before[x]], before[y] * 2 * total + total + known[here[y]]))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, unit, held = shared.value[2], -1, np.zeros(len(shared.value[2][0]))
        for batch in batches:
            if not batch.num_rows:
                continue
            u, ctx, n = (batch.column(i).to_numpy() for i in range(3))
            start = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
            sums = np.add.reduceat(n[:, None] * gains[ctx], start, axis=0)
            names = u[start]
            if names[0] == unit:
                sums[0] += held
            elif unit >= 0:
                names, sums = np.concatenate(([unit], names)), np.concatenate((held[None], sums))
            unit, held = names[-1], sums[-1]
            yield pa.record_batch([pa.array(names[:-1]), pa.array(sums[:-1].argmax(axis=1))], names=["unit", "cls"])
        if unit >= 0:
            yield pa.record_batch([pa.array([unit], pa.int64()), pa.array([held.argmax()], pa.int64())], names=["unit", "cls"])

    seen = _counted(rows, keys_of).select(F.floor(F.col("key") / (2 * total)).alias("unit"), (F.col("key") % (2 * total)).alias("ctx"), "n")
    found = seen.repartition("unit").sortWithinPartitions("unit", "ctx").mapInArrow(best, "unit long, cls long").toArrow()
    out = np.full(rest - m, default, np.int64)
    out[found.column("unit").to_numpy() - m] = found.column("cls").to_numpy()
    return out


@dataclass(frozen=True)
class Model:
    classes: Classes
    follow: np.ndarray  # log10 P(class | class before)
    emit: np.ndarray  # log10 P(word | class) of the vocabulary, in the order of its hashes
    n_tokens: int
    n_words: int  # distinct tokens, the end included
    ends: int
    tail_space: int  # a word of count c has (c + 1) / tail_space of the tail class
    floor: int  # words of this count or more are the vocabulary


def fit(learnt: DataFrame, vocab: DataFrame, top_words: int, n_classes: int, vocabulary: int, smoothing: float) -> Model:
    """The model of ``learnt.text``; ``vocab`` has its word counts."""
    ends = learnt.count()
    sums = vocab.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, v_all = int(sums["n"] or 0) + ends, int(sums["v"]) + bool(ends)
    floor = count_floor(vocab, vocabulary)
    top = vocab.where(F.col("c") >= floor).toArrow()
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    by_hash = np.argsort(h)
    m = min(top_words, len(h))
    k = min(n_classes, max(m, 1))

    # Units of the exchange: each top word, then the rest of the vocabulary with the tail, and the end.
    ranks = np.arange(len(h))
    units = Classes(h[by_hash], np.minimum(ranks, m)[by_hash], c[by_hash], m)
    shared = learnt.sparkSession.sparkContext.broadcast(units)

    def pairs_of(batch: pa.RecordBatch) -> np.ndarray:
        x, _, bounds = words(*text_buffers(batch.column(0)))
        before, here, _ = shared.value.chain(shared.value.of(x)[0], bounds)
        return before * (m + 2) + here

    pairs = _counted(learnt, pairs_of).select(F.floor(F.col("key") / (m + 2)).alias("a"), (F.col("key") % (m + 2)).alias("b"), "n")
    pairs = stored(pairs, "pairs")
    of = exchange(pairs, m, 2, k)

    # The rest of the vocabulary, by what its neighbours tell under the classes found.
    every = np.concatenate([of, [k, k + 1]])
    after, _ = contexts(pairs, every, k + 2)
    table = np.zeros((k + 2, k + 2))
    np.add.at(table, every, after.astype(float))
    chance = (table + smoothing) / (table + smoothing).sum(axis=1, keepdims=True)
    share = (table.sum(axis=0) + smoothing) / (table.sum(axis=0) + smoothing).sum()
    gains = np.concatenate([np.log(chance[:, :k] / share[:k]), np.log(chance[:k].T)])
    cls = of
    if len(h) > m:
        ranked = Classes(h[by_hash], ranks[by_hash], c[by_hash], len(h))
        cls = np.concatenate([of, placed(learnt, ranked, m, of, gains, int(table[:, :k].sum(axis=0).argmax()))])
    classes = Classes(h[by_hash], cls[by_hash].astype(np.int64), c[by_hash], k)
    size = classes.tail + 2
    table = bigram_counts(learnt, classes)
    follow = np.log10((table + smoothing) / (table.sum(axis=1, keepdims=True) + smoothing * size))
    in_class = np.bincount(classes.cls, weights=classes.counts, minlength=size) if len(h) else np.zeros(size)
    emit = np.log10(classes.counts / in_class[classes.cls]) if len(h) else np.zeros(0)
    tail_space = max(n_all - ends - int(c.sum()), 0) + (v_all - bool(ends) - len(h)) + 1
    return Model(classes, follow, emit, n_all, v_all, ends, tail_space, floor)


def score(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    top_words: int = 8192,
    n_classes: int = 32,
    vocabulary: int = 1 << 19,
    smoothing: float = 0.5,
) -> DataFrame:
    """Scores every row by a model of the rows where ``train`` holds.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end.
    Returns one row per input row: ``id_col``, ``train`` (whether it was learnt from),
    ``n_tokens``, ``n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (log10 of the add-one unigram probability), ``score`` (log10 of the
    class model's probability), ``perplexity``.

    Null text counts as empty: one token, the end.  A null ``train`` counts as false.
    Null and repeated ids get rows like any other, and repeated rows count as often as
    they occur.  Equal counts are ordered by hash; at the end of the vocabulary words of one
    count are in it together or not at all.  Without training rows every word is
    unknown and classes are equally likely.  An empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    learnt = rows.where("train")
    vocab = stored(word_counts(learnt), "vocabulary")
    model = fit(learnt, vocab, top_words, n_classes, vocabulary, smoothing)
    base_space, floor, tail_space, n_all = model.n_tokens + model.n_words + 1, model.floor, model.tail_space, model.n_tokens
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, follow, emit, ends = shared.value.classes, shared.value.follow, shared.value.emit, shared.value.ends
        first = TaskContext.get().partitionId() << 40
        names = ["row", "id", "train", "n_tokens", "n_known", "base", "model", "h", "n"]
        for batch in slices(batches, "text"):
            n = batch.num_rows
            word, owner, bounds = words(*text_buffers(batch.column(2)))
            cls, count = classes.of(word)
            here = count >= 0
            known = np.bincount(owner[here], minlength=n) + (ends > 0)
            base = np.bincount(owner[here], weights=np.log10((count[here] + 1) / base_space), minlength=n) + np.log10((ends + 1) / base_space)
            before, at, of = classes.chain(cls, bounds)
            model = np.bincount(of, weights=follow[before, at], minlength=n)
            if here.any():
                place = np.searchsorted(classes.hashes, word[here])
                model += np.bincount(owner[here], weights=emit[place], minlength=n)
            rows = np.arange(first, first + n)
            first += n
            none = pa.nulls(n, pa.int64())
            yield pa.record_batch([pa.array(rows), batch.column(0), batch.column(1), pa.array(np.diff(bounds) + 1), pa.array(known), pa.array(base), pa.array(model), none, none], names=names)
            far, who = word[~here], owner[~here]
            if len(far):
                order = np.lexsort((far, who))
                far, who = far[order], who[order]
                start = np.flatnonzero(np.concatenate(([True], (far[1:] != far[:-1]) | (who[1:] != who[:-1]))))
                times = np.diff(np.append(start, len(far)))
                k = len(start)
                yield pa.record_batch(
                    [pa.array(rows[who[start]]), pa.nulls(k, batch.schema.field(0).type), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.array(far[start].view(np.int64)), pa.array(times)],
                    names=names,
                )

    schema = f"row long, id {kind}, train boolean, n_tokens long, n_known long, base double, model double, h long, n long"
    seen = stored(rows.mapInArrow(run, schema), "scores")
    rare = seen.where("h is not null").select("row", "h", "n")
    rare = rare.join(vocab.where(F.col("c") < floor), "h", "left").select("row", "n", F.coalesce("c", F.lit(0).cast("long")).alias("c"))
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known2"),
        F.sum(F.col("n") * F.log10((F.col("c") + 1) / F.lit(float(base_space)))).alias("base2"),
        F.sum(F.col("n") * F.log10((F.col("c") + 1) / F.lit(float(tail_space)))).alias("model2"),
    )
    whole = seen.where("h is null").join(rare, "row", "left")
    total = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return whole.select(
        F.col("id").alias(id_col),
        "train",
        "n_tokens",
        total("n_known", "known2").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        total("base", "base2").alias("base_score"),
        total("model", "model2").alias("score"),
        F.pow(F.lit(10.0), -total("model", "model2") / F.col("n_tokens")).alias("perplexity"),
    )
