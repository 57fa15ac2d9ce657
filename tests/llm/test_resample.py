import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quern.llm import resample as R
from tests.llm.brute import AZ, docs


def brute(texts, ids, target, percent, least, buckets, run):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, run + 1) for i in range(len(w) - n + 1)]

    own, aim = [features(t) for t in texts], [features(t) for t in target]
    s, t = (collections.Counter(b for _, f in side for b in f) for side in (own, aim))
    ns, nt = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * ns / ((s[b] + 1) * nt)))
    out = []
    for i, (n, f) in zip(ids, own, strict=True):
        weight = math.floor(sum(map(gain, f)) / len(f)) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def held(rows):
    return sorted(map(str, map(tuple, rows)))


@pytest.mark.parametrize("run,percent", [(1, 0), (1, 10), (2, 100), (3, 10)])
def test_matches_a_plain_version(spark, sf, run, percent):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts += [None, "", "one", "Two words", "ÉÉ zß 漢字 x1", "-- !!", "word " * 30000, *["same text of five words"] * 4]
    target = ["Two words and more words", None, "漢字 x1 x1"]
    ids = list(range(100, 100 + len(texts)))
    got = R.resample(docs(spark, texts, ids), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), percent, 2, 64, run)
    assert held(got.collect()) == held(brute(texts, ids, target, percent, 2, 64, run))


def test_draw_is_whole_and_dense(spark, sf):
    rows = R.resample(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    drawn = sorted((r["rank"], -r["score"]) for r in rows if r["rank"])
    fit = sum(r["n_features"] >= 20 for r in rows)
    assert [r for r, _ in drawn] == list(range(1, fit // 10 + 1)) and [s for _, s in drawn] == sorted(s for _, s in drawn)


def test_ties_nulls_and_repeats(spark):
    scored = spark.createDataFrame([(5, 7), (2, 7), (None, 7), (9, 8), (2, 7), (1, 3)], "id long, score long")
    for draw in range(7):
        got = {(r["id"], r["rank"]) for r in R.ranked_draw(scored, draw).collect()}
        order = [9, 2, 2, 5, None, 1]
        assert {x for x in got if x[1]} == {(i, k) for k, i in enumerate(order[:draw], 1)}
        assert R.ranked_draw(scored, draw).count() == 6


def test_empty_tables_clashes_and_bounds(spark):
    some = docs(spark, ["a b c"] * 3, [None, 4, 4])
    none = spark.createDataFrame([], "item_id long, text string")
    clash = some.withColumns({c: F.lit("x") for c in ("id", "score", "rank", "features", "words", "weight", "bucket", "n")})
    assert held(R.resample(clash, none, 100, 1).collect()) == held(brute(["a b c"] * 3, [None, 4, 4], [], 100, 1, 10000, 1))
    assert R.resample(some.limit(0), none).count() == 0
    with pytest.raises(ValueError):
        R.resample(some, none, buckets=0)


def test_draw_leans_to_the_target(spark):
    texts = ["alpha beta gamma delta " * 6] * 300 + ["one two three four " * 6] * 300
    rows = R.resample(docs(spark, texts), spark.createDataFrame([(0, "alpha beta " * 500)], "item_id long, text string"), 30).where("rank is not null").collect()
    assert sum(r["doc_id"] < 300 for r in rows) > 0.9 * 180 and len(rows) == 180
