"""Repeated passages by longest-previous-factor arrays over sharded suffix arrays.

A byte is repeated if a string of ``length`` bytes that covers it also starts elsewhere.
Strings are dealt to shards by an anchor: the least of the hashes of their k-byte pieces.
Equal strings have equal anchors, so they meet; strings in a row that share an anchor
stay together as one context, so a text is cut in few pieces.  Anchors seen once drop out
before any text moves.  Equal contexts are collapsed with their number before the texts of
the others are sent to shards.

In a shard, a suffix array (by prefix doubling) over its contexts gives the order of all
strings; longest common prefixes of neighbours, and the previous and next smaller
positions in suffix order, give each string its longest previous factor.  With
``keep="first"`` strings with an earlier match are removed; with ``keep="none"`` those
with an earlier or, by the same factors over mirrored positions, a later one.

An anchor with more than MAX_CONTEXTS different contexts is not gathered in one task: its
strings are hashed one by one and counted by grouped aggregation, which is as exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.bytescan import mix, slices, text_buffers
from quern.llm.common import BROADCAST_BYTES, HOT_KEYS, stored

PIECE = 40
MAX_CONTEXTS = 2048
#: Bytes of contexts in one suffix array.
SHARD_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64)
_cache: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _cache[name] = np.cumprod(p)
    return _cache["up"][:n], _cache["down"][:n]


class Hashes:
    """Hashes of any substring of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def pieces(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, context hash, owner, start in its text and size of each context of a batch."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    hashes = Hashes(data)
    pieces = hashes.pieces(piece)
    low = ((pieces >> _U(32)) << _U(32)) | np.arange(len(pieces), dtype=np.uint64)
    span, width = length - piece + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    least = (low & _U(0xFFFFFFFF)).astype(np.int64)  # for each string, where its least piece starts
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.cumsum(sizes) - sizes
    at = np.arange(len(owner)) - begin[owner] + offsets[owner]
    if not len(at):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    where = least[at]
    first = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (owner[1:] != owner[:-1]))))
    last = np.append(first[1:], len(at)) - 1
    start, end = at[first], at[last] + length
    return pieces[where[first]], hashes.of(start, end), owner[first], start - offsets[owner[first]], end - start


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array over ``starts`` and common prefixes of neighbours, both up to ``length``.

    Each start must have ``length`` bytes before the end of ``data``.  Returns indices into
    ``starts`` in suffix order (ties by start), and for each the common prefix with the one
    before it (the first has 0).
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    packed = np.zeros(n, np.uint64)
    for j in range(8):
        packed = (packed << _U(8)) | padded[j : j + n].astype(np.uint64)
    levels: list[tuple[int, np.ndarray]] = []
    size = min(8, length)
    key = packed >> _U(8 * (8 - size))
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    levels.append((size, rank))
    while 2 * size <= length:
        pair = np.full(n, -1, np.int64)
        m = max(n - size, 0)
        pair[:m] = rank[:m] * (n + 1) + rank[size : size + m] + 1
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        size *= 2
        levels.append((size, rank))
    final = rank[starts] * (n + 1) + rank[starts + length - size]
    order = np.lexsort((starts, final))
    a, b = starts[order][:-1], starts[order][1:]
    same = np.zeros(len(a), np.int64)
    for step, level in reversed(levels):
        for _ in range(2 if step == levels[-1][0] else 1):
            room = same + step <= length
            x, y = np.minimum(a + same, n - 1), np.minimum(b + same, n - 1)
            same += np.where(room & (level[x] == level[y]), step, 0)
    for _ in range(min(8, length)):
        x, y = np.minimum(a + same, n - 1), np.minimum(b + same, n - 1)
        more = (same < length) & (data[x] == data[y])
        if not more.any():
            break
        same += more
    return order, np.concatenate(([0], same)) if len(starts) else same


def _factor(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For suffixes in suffix order, the longest match that has a smaller position: with the
    previous or the next suffix of smaller position, whichever shares more."""
    after = np.append(common[1:], 0)
    return np.maximum(_smaller(position, common), _smaller(position[::-1], after[::-1])[::-1])


def _smaller(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the nearest one before it in suffix order that has
    a smaller position; 0 if there is none.  Pointers jump along earlier answers."""
    n = len(position)
    before = np.arange(n) - 1
    shared = common.copy()
    active = np.flatnonzero(before >= 0)
    active = active[position[before[active]] > position[active]]
    while len(active):
        to = before[active]
        shared[active] = np.minimum(shared[active], shared[to])
        before[active] = before[to]
        active = active[before[active] >= 0]
        active = active[position[before[active]] > position[active]]
    shared[before < 0] = 0
    return shared


def longest_previous_factor(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start, up to ``length``: longest previous factor, and longest next factor.

    The next factor is the previous one of the mirrored positions: a match that starts later.
    """
    order, common = suffix_order(data, starts, length)
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    position = starts[order]
    lpf, lnf = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
    lpf[order] = _factor(position, common)
    lnf[order] = _factor(-position, common)
    return lpf, lnf


def _ranges(marked: np.ndarray) -> list[int]:
    """[first, last, first, last, ...] of the runs of True."""
    if not marked.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0]))))
    edge[1::2] -= 1
    return edge.tolist()


def _content(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _by_size(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join, one row a key on the right; keys of over 1/1024 of all rows by broadcast."""
    hot = F.broadcast(right.where(F.col(weight) > total // HOT_KEYS))
    cold = right.where(F.col(weight) <= total // HOT_KEYS)
    return left.join(hot, on).unionByName(left.join(hot.select(*on), on, "left_anti").join(cold, on))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep: str = "none", piece: int = PIECE, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """(k1, k2, id, ranges): by content (and id, for keep="first"), the starts of strings to
    remove, as an array of (low, high)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            anchor, ctx, owner, start, size = contexts(*text_buffers(batch.column(3)), length, piece)
            owner = pa.array(owner)
            yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(ctx.view(np.int64)), *(batch.column(i).take(owner) for i in range(3)), pa.array(start, pa.int32()), pa.array(size, pa.int32())], names=["anchor", "ctx", "id", "k1", "k2", "start", "size"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), *_content(F.col(text_col)), text.alias("text"))
    seen = rows.where(F.octet_length("text") >= length).mapInArrow(scan, f"anchor long, ctx long, id {kind}, k1 long, k2 long, start int, size int")
    seen = stored(seen, "contexts")
    total = seen.count()
    live = seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("ctx").alias("low"), F.max("ctx").alias("high")).where("c > 1")
    live = stored(live.select("anchor", "c", (F.col("low") != F.col("high")).alias("contested")), "anchors")
    posted = stored(_by_size(seen, live, ["anchor"], "c", total).drop("c"), "posted")

    first = F.min(F.struct("id", "start", "k1", "k2", "size")).alias("first")
    distinct = stored(posted.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("n"), first, F.first("contested").alias("contested")), "distinct")
    wanted = distinct.where("contested").select("anchor", "ctx", "n", "first.*")
    many = stored(wanted.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > max_contexts).select("anchor"), "many")
    cuts = wanted.groupBy("k1", "k2", "id").agg(F.collect_list(F.struct("anchor", "ctx", "n", "start", "size")).alias("cuts")).withColumnRenamed("id", "want_id")
    cuts = stored(cuts, "cuts")
    size = cuts.agg(F.sum(F.size("cuts") * 36 + 64)).first()[0] or 0
    near = F.broadcast if size <= BROADCAST_BYTES else (lambda df: df)
    texts = rows.join(near(cuts), ["k1", "k2"]).where(F.col("id").eqNullSafe(F.col("want_id"))).select("id", "k1", "k2", "text", "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            data, offsets = text_buffers(batch.column(3))
            column = batch.column(4)
            flat = column.flatten()
            owner = np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy())
            a, b = flat.field("start").to_numpy() + offsets[owner], flat.field("size").to_numpy()
            raw = data.tobytes()
            pieces = [raw[x : x + y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            who = pa.array(owner)
            yield pa.record_batch([flat.field("anchor"), flat.field("ctx"), batch.column(0).take(who), flat.field("start"), pa.array(pieces, pa.binary())], names=["anchor", "ctx", "id", "start", "bytes"])

    pieces = stored(texts.mapInArrow(cut, f"anchor long, ctx long, id {kind}, start int, bytes binary").dropDuplicates(["anchor", "ctx"]), "pieces")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        weight = 0

        def solve() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
            sizes = np.array([len(x[2]) for x in held])
            begin = np.cumsum(sizes) - sizes
            windows = sizes - length + 1
            owner = np.repeat(np.arange(len(held)), windows)
            bound = np.cumsum(windows)
            starts = np.arange(len(owner)) - (bound - windows)[owner] + begin[owner]
            lpf, lnf = longest_previous_factor(data, starts, length)
            marks = (lpf if keep == "first" else np.maximum(lpf, lnf)) >= length
            out = [_ranges(marks[e - w : e]) for e, w in zip(bound.tolist(), windows.tolist(), strict=True)]
            return pa.record_batch([pa.array([x[0] for x in held]), pa.array([x[1] for x in held]), pa.array(out, pa.list_(pa.int32()))], names=["anchor", "ctx", "runs"])

        for batch in batches:
            for anchor, ctx, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if weight >= SHARD_BYTES and anchor != held[-1][0]:
                    yield solve()
                    held.clear()
                    weight = 0
                held.append((anchor, ctx, raw))
                weight += len(raw)
        if held:
            yield solve()

    few = pieces.join(F.broadcast(many), "anchor", "left_anti") if many.count() * 16 <= BROADCAST_BYTES else pieces.join(many, "anchor", "left_anti")
    few = few.select("anchor", "ctx", "bytes", "id", "start").repartition("anchor").sortWithinPartitions("anchor", "id", "start")
    solved = few.select("anchor", "ctx", "bytes").mapInArrow(shards, "anchor long, ctx long, runs array<int>")

    # Anchors with very many contexts: each string by itself.
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 1 << 18):
            data, offsets = text_buffers(batch.column(batch.schema.get_field_index("bytes")))
            windows = np.diff(offsets) - length + 1
            owner = np.repeat(np.arange(batch.num_rows), windows)
            at = np.arange(len(owner)) - (np.cumsum(windows) - windows)[owner]
            h = Hashes(data).of(at + offsets[owner], at + offsets[owner] + length)
            who = pa.array(owner)
            yield pa.record_batch([*(batch.column(i).take(who) for i in range(4)), pa.array(at, pa.int32()), pa.array(h.view(np.int64))], names=["anchor", "ctx", "id", "start", "at", "string"])

    each = pieces.join(many, "anchor", "left_semi").select("anchor", "ctx", "id", "start", "bytes")
    each = stored(each.mapInArrow(strings, f"anchor long, ctx long, id {kind}, start int, at int, string long"), "strings")
    counts = each.groupBy("string").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", F.col("start") + F.col("at"))).alias("least")).where("c > 1")
    known = _by_size(each, stored(counts, "string_counts"), ["string"], "c", max(each.count(), 1))
    if keep == "first":
        known = known.where(F.struct("id", F.col("start") + F.col("at")) != F.col("least"))
    loose = known.groupBy("anchor", "ctx").agg(F.flatten(F.collect_list(F.array("at", "at"))).alias("runs"))

    # What each context's strings come to: the shard's runs, or all of them if it has a copy.
    solved = stored(solved.where(F.size("runs") > 0).unionByName(loose), "runs")
    verdict = distinct.select("anchor", "ctx", "n", "first").join(solved, ["anchor", "ctx"], "left").where("n > 1 or runs is not null")
    verdict = stored(verdict.withColumnRenamed("first", "origin"), "verdicts")
    marks = _by_size(posted.drop("contested"), verdict, ["anchor", "ctx"], "n", max(posted.count(), 1))
    whole = F.col("n") > 1
    if keep == "first":
        whole = whole & ~(F.col("id").eqNullSafe(F.col("origin.id")) & (F.col("start") == F.col("origin.start")) & (F.col("k1") == F.col("origin.k1")) & (F.col("k2") == F.col("origin.k2")))
    pair = lambda low, high: F.struct((F.col("start") + low).cast("int").alias("low"), (F.col("start") + high).cast("int").alias("high"))
    runs = F.coalesce("runs", F.array().cast("array<int>"))
    half = F.expr("sequence(0, size(runs) div 2 - 1)")
    inside = F.when(F.size(runs) > 0, F.transform(half, lambda j: pair(F.get("runs", (2 * j).cast("int")), F.get("runs", (2 * j + 1).cast("int"))))).otherwise(F.array().cast("array<struct<low:int,high:int>>"))
    pairs = F.when(whole, F.array(pair(F.lit(0), F.col("size") - length))).otherwise(inside)
    who = F.col("id") if keep == "first" else F.lit(None).cast(kind)
    marks = marks.where(whole | (F.size("runs") > 0)).select("k1", "k2", who.alias("id"), F.explode(pairs).alias("r")).distinct()
    return marks.groupBy("k1", "k2", "id").agg(F.collect_list("r").alias("ranges"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep: str = "first", **options) -> DataFrame:
    """Removes every byte covered by a repeated string of ``length`` bytes.

    ``keep="first"`` keeps the first occurrence (by id, then place; null ids come first)
    and removes later ones; ``keep="none"`` removes all.  Returns one row per input row:
    ``id_col``, ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs as structs of
    start and end, in bytes), ``kept`` (the remaining bytes), ``kept_sha256``.

    Null text counts as empty.  Texts shorter than ``length`` lose nothing.  Strings may
    overlap, and are judged on the input.  Rows repeated with the same id and text get the
    same result (with keep="first" they count as one).  Ids may be null.  Other columns are ignored; an empty
    table gives an empty result.  Texts are matched with their contents by 128 bits of
    hash, strings of very frequent anchors by 64.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    # Spans grow with the corpus, so texts meet them in a shuffle join at every size.
    found = stored(repeated(docs, id_col, text_col, length, keep, **options), "spans").withColumnRenamed("id", "for_id").hint("merge")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *_content(F.col(text_col)))
    on = (rows["k1"] == found["k1"]) & (rows["k2"] == found["k2"])
    if keep == "first":
        on = on & rows["id"].eqNullSafe(found["for_id"])
    rows = rows.join(found, on, "left").select("id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_buffers(batch.column(1))
            raw = data.tobytes()
            removed, spans, kept, shas = [], [], [], []
            column = batch.column(2)
            for i in range(batch.num_rows):
                own = raw[offsets[i] : offsets[i + 1]]
                runs: list[list[int]] = []
                if column[i].is_valid:
                    flat = column[i].values
                    lows, highs = flat.field("low").to_numpy(), flat.field("high").to_numpy() + length
                    for j in np.argsort(lows, kind="stable").tolist():
                        a, b = int(lows[j]), int(highs[j])
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        else:
                            runs.append([a, b])
                rest, at = [], 0
                for a, b in runs:
                    rest.append(own[at:a])
                    at = b
                rest.append(own[at:])
                left = b"".join(rest)
                removed.append(len(own) - len(left))
                spans.append([{"start": a, "end": b} for a, b in runs])
                kept.append(left)
                shas.append(hashlib.sha256(left).hexdigest())
            yield pa.record_batch(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary()), pa.array(shas, pa.string())],
                names=["id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"],
            )

    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary, kept_sha256 string")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "spans", "kept", "kept_sha256")
