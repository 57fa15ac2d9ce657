"""N-gram Jaccard self-join by a grouped prefix join.

A document is its set of distinct k-word shingles, ordered the same way everywhere:
shingles found in many prefixes last, otherwise by hash.  Two sets that overlap enough
must share a shingle among their first few (the prefix), so only prefixes are indexed.

Documents with the same set are one member; members with the same prefix and size are one
group, and the index holds groups.  All groups that share a shingle are a family, known by
its first group: the one with the fewest rare shingles in its prefix, which in a family of
near copies is close to their common origin.  Families are joined in two rounds:

1. the first group's head against the heads of the others, and a group's head against its
   members, which connects most copies at a cost in line with the index;
2. where members of a family, or of a group, are still in several components, members of
   different components against each other.  Long lists are dealt in blocks, and those of the
   largest component meet only the others.

Each round works in cells, a bounded list each.  Pairs of a cell are filtered by size and by a
parity signature; then the whole sets of the members that are left come to the cell, and it
verifies pairs until they connect.  So a cell sends on no more links than it has members,
however many of its pairs link.  A pair left out is in one component already, so the
components are exact.

A parity signature has one bit for each hash slot, flipped by every shingle that falls in
it.  Two signatures cannot differ in more bits than the sets differ in shingles, so a pair
is dropped only if it cannot reach the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.bytescan import shingles, slices, text_buffers, words
from quern.llm.common import BROADCAST_BYTES, HOT_KEYS, stored, unused
from quern.operators.graph import connected_components

#: A shingle in this many prefixes is ordered after all others.
FREQUENT = 64
#: Bound on the shingles ordered last; they are broadcast, 8 bytes each.
MAX_FREQUENT = 1 << 18
#: Members of a block, and bytes of their sets.
BLOCK = 512
BLOCK_BYTES = 4 << 20


def prefix_length(n: int, percent: int) -> int:
    """How many first shingles two sets of n or more must share one of."""
    return n - -(-percent * n // 100) + 1


def signature(tokens: np.ndarray) -> bytes:
    bits = 512
    while bits < 4 * len(tokens) and bits < 1 << 18:
        bits *= 2
    return np.packbits((np.bincount((tokens >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _fold(sig: np.ndarray, size: int) -> np.ndarray:
    while sig.shape[-1] > size:
        half = sig.shape[-1] // 2
        sig = sig[..., :half] ^ sig[..., half:]
    return sig


_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint16)


def may_link(n_a: np.ndarray, n_b: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in at least ``differ`` shingles can reach percent."""
    return (100 - percent) * (n_a + n_b) >= (100 + percent) * differ


def _name(rare: int, prefix: np.ndarray, n: int) -> int:
    """A group's name: its share of rare shingles, then a hash of prefix and size.  Groups that
    share a name by chance are handled as one, and their pairs verified like any other."""
    low = int.from_bytes(hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest(), "little")
    return (1000 * rare // max(len(prefix), 1)) << 53 | low >> 11


def profiles(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(id, key, n, set_key, group, prefix, sig) of every row; prefix follows the common order."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch in slices(batches, "text"):
            h, _, bounds = words(*text_buffers(batch.column(2)))
            n, keys, groups, prefixes, sigs = [], [], [], [], []
            for own in shingles(h, bounds, k):
                n.append(len(own))
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                sigs.append(signature(own))
                size = prefix_length(len(own), percent) if len(own) else 0
                first, rare = own[:size], size
                if len(last) and len(own):
                    late = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own
                    if late.any():
                        first = np.concatenate((own[~late], own[late]))[:size]
                        rare = min(size, len(own) - int(late.sum()))
                groups.append(_name(rare, first, len(own)))
                prefixes.append(first.view(np.int64))
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            at = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(keys, pa.binary()), pa.array(groups, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(sigs, pa.binary())],
                names=["id", "key", "n", "set_key", "group", "prefix", "sig"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, key long, n int, set_key binary, group long, prefix array<long>, sig binary")


def frequent_shingles(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> np.ndarray:
    """Shingles in FREQUENT prefixes or more; if those are over MAX_FREQUENT, the most frequent."""
    seen = profiles(docs, id_col, text_col, k, percent, np.zeros(0, np.uint64)).select(F.explode("prefix").alias("token"))
    often = stored(seen.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= FREQUENT), "frequent")
    spread = sorted(((r["c"], r["v"]) for r in often.groupBy(F.least("c", F.lit(1 << 16)).alias("c")).agg(F.count(F.lit(1)).alias("v")).collect()), reverse=True)
    floor, held = 1 << 62, 0
    for c, v in spread:
        held += v
        if held > MAX_FREQUENT:
            break
        floor = c
    return np.sort(often.where(F.col("c") >= floor).select("token").toArrow().column("token").to_numpy().view(np.uint64))


def _sized_join(left: DataFrame, right: DataFrame, on: str, weight: str, total: int) -> DataFrame:
    """Inner join with one row a key on the right; keys with over 1/1024 of all rows, of
    which there can be 1024, join by broadcast."""
    hot = F.broadcast(right.where(F.col(weight) > total // HOT_KEYS))
    cold = right.where(F.col(weight) <= total // HOT_KEYS)
    return left.join(hot, on).unionByName(left.join(hot.select(on), on, "left_anti").join(cold, on))


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches cut so that no cell (columns 0 to 2) spans two, with the bounds of their cells."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = joined()
        key = [rows.column(c).to_numpy() for c in range(3)]
        change = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
        if len(change):
            last = int(change[-1])
            yield rows.slice(0, last), [0, *change.tolist()]
            held = [rows.slice(last)]
        else:
            held = [rows]
    if held:
        rows = joined()
        yield rows, [0, rows.num_rows]


def _near(side: np.ndarray | None, label: np.ndarray, n: np.ndarray, sigs: list[bytes], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For members x of a cell, the later ones that sizes and signatures allow to link with x.

    Only pairs of different labels count, and with ``side`` only those from both sides.
    """
    size = len(n)
    if size <= 8:
        raw = [np.frombuffer(s, np.uint8) for s in sigs]
        for x in range(size):
            ys = []
            for y in range(x + 1, size):
                if label[x] != label[y] and (side is None or side[x] != side[y]) and 100 * min(n[x], n[y]) >= percent * max(n[x], n[y]):
                    w = min(len(raw[x]), len(raw[y]))
                    differ = int(np.bitwise_count(_fold(raw[x], w) ^ _fold(raw[y], w)).sum())
                    if may_link(n[x], n[y], differ, percent):
                        ys.append(y)
            if ys:
                yield x, np.array(ys)
        return
    width = np.array([len(s) for s in sigs])
    at = np.empty(size, np.int64)
    stacks: dict[tuple[int, int], np.ndarray] = {}
    widths = np.unique(width).tolist()
    for w in widths:
        own = np.flatnonzero(width == w)
        at[own] = np.arange(len(own))
        stacks[w, w] = np.stack([np.frombuffer(sigs[x], np.uint8) for x in own.tolist()])
        for to in widths:
            if to < w:
                stacks[w, to] = np.ascontiguousarray(_fold(stacks[w, w], to))
    stacks = {key: v.view(np.uint64) for key, v in stacks.items()}
    for x in range(size):
        fits = (label != label[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        fits[: x + 1] = False
        if side is not None:
            fits &= side != side[x]
        found = []
        for w in widths:
            ys = np.flatnonzero(fits & (width == w))
            if len(ys):
                to = min(w, int(width[x]))
                differ = np.bitwise_count(stacks[w, to][at[ys]] ^ stacks[int(width[x]), to][at[x]]).sum(axis=1, dtype=np.int64)
                found.append(ys[may_link(n[x], n[ys], differ, percent)])
        if found and len(ys := np.concatenate(found)):
            yield x, ys


def _links(lists: DataFrame, docs: DataFrame, members: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(a, b) of set keys: links that connect whatever the pairs of each cell connect.

    ``lists``: first, i, j, side, label, set_key, n.  A cell (first, i, j) holds one block
    (i = j), whose members meet each other, or two, which meet across sides.
    """
    names = ["first", "i", "j", "side", "label", "set_key", "n", "sig"]
    kinds = "first long, i int, j int, side int, label binary, set_key binary, n int, sig binary"
    deal = lambda df: df.repartition("first", "i", "j").sortWithinPartitions("first", "i", "j")

    def cells(rows: pa.RecordBatch, bounds: list[int]) -> Iterator[tuple]:
        i, j, side, n = (rows.column(c).to_numpy() for c in (1, 2, 3, 6))
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            if e - s > 1:
                ids: dict[bytes, int] = {}
                label = np.array([ids.setdefault(x, len(ids)) for x in rows.column(4).slice(s, e - s).to_pylist()])
                sigs = rows.column(7).slice(s, e - s).to_pylist()
                yield s, e, label, _near(None if i[s] == j[s] else side[s:e], label, n[s:e].astype(np.int64), sigs, percent)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _whole_cells(batches):
            mark = np.zeros(rows.num_rows, bool)
            for s, _, _, near in cells(rows, bounds):
                for x, ys in near:
                    mark[s + x] = True
                    mark[s + ys] = True
            yield rows.filter(pa.array(mark))

    rows = lists.join(members.select("set_key", "sig"), "set_key").select(*names)
    rows = stored(deal(rows).mapInArrow(wanted, kinds), "wanted")
    needed = stored(rows.select("set_key").distinct().join(members.select("set_key", "at"), "set_key"), "needed")
    few = F.broadcast if needed.count() * 64 <= BROADCAST_BYTES else (lambda df: df)
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    source = source.join(few(needed), F.col("id").eqNullSafe(F.col("at.id")) & (F.col("key") == F.col("at.key"))).select("set_key", "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, _, bounds = words(*text_buffers(batch.column(1)))
            keys, sets = [], []
            for want, own in zip(batch.column(0).to_pylist(), shingles(h, bounds, k), strict=True):
                if hashlib.blake2b(own.tobytes(), digest_size=16).digest() == want:
                    keys.append(want)
                    sets.append(own.tobytes())
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["set_key", "tokens"])

    sets = stored(source.mapInArrow(whole, "set_key binary, tokens binary").dropDuplicates(["set_key"]), "sets")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _whole_cells(batches):
            links: list[tuple[bytes, bytes]] = []
            for s, e, label, near in cells(rows, bounds):
                tokens = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column(8).slice(s, e - s)]
                keys = rows.column(5).slice(s, e - s).to_pylist()
                of = label.copy()
                for x, ys in near:
                    for y in ys.tolist():
                        if of[x] != of[y]:
                            p, q = tokens[x], tokens[y]
                            both = len(np.intersect1d(p, q, assume_unique=True))
                            if 100 * both >= percent * (len(p) + len(q) - both):
                                of[of == of[y]] = of[x]
                                links.append((keys[x], keys[y]))
            yield pa.record_batch([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], names=["a", "b"])

    both = deal(rows.join(sets, "set_key").select(*names, "tokens"))
    return stored(both.mapInArrow(verified, "a binary, b binary"), "links")


def _blocks(count: str, sizes: str) -> Column:
    """Blocks for this many members and shingles."""
    return F.ceil(F.greatest(F.col(count) / BLOCK, F.col(sizes) * 8 / BLOCK_BYTES)).cast("int")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard index of ``percent`` or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  With fewer than k words the
    whole sequence is the one shingle; without words the set is empty and links nothing.
    Returns one row per input row: ``id_col``, ``n_shingles``, ``component_id`` (smallest
    id reachable by links, its own included).

    Null text counts as empty.  A row with a null id has component_id null if no linked
    row has an id.  Repeated rows are linked (equal sets are), as are equal ids only if
    their texts are.  Other columns are ignored; an empty table gives an empty result.
    Shingles are told apart by 64-bit hashes.
    """
    frequent = frequent_shingles(docs, id_col, text_col, k, percent)
    seen = stored(profiles(docs, id_col, text_col, k, percent, frequent), "profiles")
    full = seen.where("n > 0")
    at = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("at")
    members = full.groupBy("set_key").agg(at, F.first("n").alias("n"), F.first("group").alias("group"), F.first("sig").alias("sig"))
    members = stored(members, "members")
    groups = stored(members.groupBy("group").agg(F.min(F.struct("set_key", "n")).alias("head"), F.count(F.lit(1)).alias("size")), "groups")

    # The index: one row for each shingle in a group's prefix.
    index = stored(full.select("group", "prefix").distinct().select("group", F.explode("prefix").alias("token")), "index")
    runs = stored(index.groupBy("token").agg(F.min("group").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1"), "runs")
    families = stored(_sized_join(index, runs, "token", "c", index.count()).select("first", "group").distinct(), "families")
    total = families.count()

    # Round 1: stars around the first head of a family, and around the head of a group.
    heads = groups.select(F.col("group").alias("first"), F.col("head.set_key").alias("head"), F.col("head.n").alias("head_n"))
    stars = families.where("group <> first").join(groups, "group").select("first", F.col("head.set_key").alias("set_key"), F.col("head.n").alias("n"))
    inner = members.select("group", "set_key", "n").join(groups.where("size > 1").select("group", "head"), "group").where(F.col("set_key") != F.col("head.set_key"))
    stars = stars.unionByName(inner.select(F.col("group").alias("first"), "set_key", "n"))
    centres = stars.groupBy("first").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w")).join(heads, "first")
    centres = stored(centres.withColumn("blocks", _blocks("c", "w")), "centres")
    stars = _sized_join(stars, centres, "first", "c", total).where(100 * F.least("n", "head_n") >= percent * F.greatest("n", "head_n"))
    zero, one = F.lit(0).alias("i"), F.lit(1)
    stars = stars.select("first", zero, (F.pmod(F.xxhash64("set_key"), F.col("blocks")) + 1).cast("int").alias("j"), one.alias("side"), F.col("set_key").alias("label"), "set_key", "n")
    centres = centres.select("first", zero, F.explode(F.sequence(one, "blocks")).alias("j"), F.lit(0).alias("side"), F.col("head").alias("label"), F.col("head").alias("set_key"), F.col("head_n").alias("n"))
    links = _links(stars.unionByName(centres), docs, members, id_col, text_col, k, percent)
    labels = stored(connected_components(links, "a", "b"), "labels")

    # Round 2: families, and groups in no family, whose members are still apart.
    placed = members.select("set_key", "group", "n").join(labels.select(F.col("node").alias("set_key"), "component"), "set_key", "left")
    placed = stored(placed.select("set_key", "group", "n", F.coalesce("component", "set_key").alias("label")), "placed")
    spread = stored(placed.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high")), "spread")
    alone = spread.where("low <> high").select(F.col("group").alias("first"), "group").join(families.select("group").distinct(), "group", "left_anti")
    mixed = families.join(spread, "group").groupBy("first").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("c")).where("low <> high")
    listed = _sized_join(families, stored(mixed.select("first", "c"), "mixed"), "first", "c", total).select("first", "group").unionByName(alone.select("first", "group"))
    listed = stored(listed.join(placed, "group").select("first", "set_key", "n", "label"), "listed")
    shares = listed.groupBy("first", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    tops = shares.groupBy("first").agg(F.sum("m").alias("c"), F.sum("w").alias("w"), F.max(F.struct("m", "label", "w")).alias("top"))
    tops = tops.select("first", "c", "w", F.col("top.label").alias("top"), F.col("top.m").alias("top_c"), F.col("top.w").alias("top_w"), (F.col("c") - F.col("top.m")).alias("rest_c"), (F.col("w") - F.col("top.w")).alias("rest_w"))
    small = _blocks("c", "w") <= 1
    tops = stored(tops.select("first", "c", "top", F.when(small, 1).otherwise(_blocks("rest_c", "rest_w")).alias("rest"), F.when(small, 0).otherwise(_blocks("top_c", "top_w")).alias("most")), "tops")
    dealt = _sized_join(listed, tops, "first", "c", listed.count())
    # Blocks 0 .. rest - 1 hold the other labels, rest .. rest + most - 1 the largest one.
    in_top = (F.col("label") == F.col("top")) & (F.col("most") > 0)
    block = F.when(in_top, F.col("rest") + F.pmod(F.xxhash64("set_key"), F.greatest("most", one))).otherwise(F.pmod(F.xxhash64("set_key"), F.col("rest"))).cast("int")
    dealt = dealt.withColumn("block", block).withColumn("others", F.when(in_top, F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("most") - 1)))
    dealt = dealt.select("first", "label", "set_key", "n", "block", F.explode("others").alias("o"))
    dealt = dealt.select("first", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), (F.col("block") > F.col("o")).cast("int").alias("side"), "label", "set_key", "n")
    again = _links(dealt, docs, members, id_col, text_col, k, percent)
    final = stored(connected_components(links.union(again), "a", "b"), "components")

    named = members.join(final.select(F.col("node").alias("set_key"), "component"), "set_key", "left").select("set_key", "at.id", F.coalesce("component", "set_key").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.select("set_key", "component").join(least, "component").select("set_key", "component_id")
    many = full.groupBy("set_key").agg(F.count(F.lit(1)).alias("c"))
    sized = stored(named.join(many, "set_key"), "sized")
    out = _sized_join(full.select("id", "n", "set_key"), sized, "set_key", "c", full.count()).select("id", "n", "component_id")
    empty = seen.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return out.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input rows, all columns as they are, without those whose component has a smaller id.

    Rows that share the smallest id of their component all stay, repeated rows too, and so do
    rows with a null id, which no list of ids can name.  Rows whose text is null or empty are
    components of their own and stay.  An empty table gives an empty result.  Dropped ids are
    broadcast while measured to be few.
    """
    name = unused(docs, "near_copy")
    found = components(docs, id_col, text_col, **options).select(F.col(id_col).alias(name), "component_id")
    found = stored(found.where(F.col(name) != F.col("component_id")).select(name).distinct(), "near_copies")
    if found.count() * 16 <= BROADCAST_BYTES:
        found = F.broadcast(found)
    return docs.join(found, F.col(id_col) == F.col(name), "left_anti")


SQL = r"""
WITH RECURSIVE
t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
arcs AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(node, other) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.node, x.b FROM reach r JOIN arcs x ON x.a = r.other)
SELECT t.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM t JOIN reach ON node = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id
"""
