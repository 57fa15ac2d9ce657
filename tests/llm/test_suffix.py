import random

import numpy as np
import pytest

from quern.llm import suffix_dedup as S
from tests.llm.brute import docs, removed


def corpus(seed=2):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    a, b = say(90), say(70)
    return [None, "", "short", a + say(50), say(20) + a + say(30), b + b, say(300), a, a, say(10) + b[10:] + say(40), "xy" * 80, "z" * 100]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("many", [2048, 2])
def test_matches_plain_search(spark, keep, many):
    texts = corpus()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in S.remove(docs(spark, texts), length=40, keep=keep, piece=12, max_contexts=many).collect()}
    assert got == dict(enumerate(removed(texts, 40, keep)))


def test_factors_match_plain():
    rng = np.random.default_rng(3)
    data = np.frombuffer(bytes(rng.integers(97, 100, 400).astype(np.uint8)), np.uint8)
    starts = np.arange(0, 380)
    lpf, lnf = S.longest_previous_factor(data, starts, 20)
    raw = data.tobytes()
    same = lambda i, j: next((n for n in range(20) if raw[i + n] != raw[j + n]), 20)
    for i in starts[::7].tolist():
        assert lpf[i] == max((same(i, j) for j in range(i)), default=0)
        assert lnf[i] == max((same(i, j) for j in range(i + 1, 380)), default=0)


def test_null_ids_and_empty(spark):
    df = docs(spark, ["k" * 60, "k" * 60, None], [None, 1, None]).withColumnRenamed("lang", "spans")
    assert sorted(r["n_removed"] for r in S.remove(df, length=50, keep="none", piece=10).collect()) == [0, 60, 60]
    assert S.remove(df.limit(0)).count() == 0
