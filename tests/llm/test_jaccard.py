import random

import pytest

from quern.llm import jaccard_join as J
from tests.llm.brute import docs, jaccard_components


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    texts = [None, "", "one two", "One  TWO", "a b c d e"]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(40, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            other = list(base)
            for _ in range(rng.randint(0, 3)):
                other[rng.randrange(len(other))] = rng.choice(vocab)
            texts.append(" ".join(other))
    texts += [passage + " " + " ".join(rng.choice(vocab) for _ in range(80)) for _ in range(40)]
    hot = [rng.choice(vocab) for _ in range(150)]
    for _ in range(90):
        other = list(hot)
        for _ in range(rng.randint(1, 6)):
            other[rng.randrange(len(other))] = rng.choice(vocab)
        texts.append(" ".join(other))
    texts += [texts[10]] * 20
    return texts


@pytest.mark.parametrize("frequent,block", [(64, 512), (8, 16)])
def test_components_match_all_pairs(spark, monkeypatch, frequent, block):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "BLOCK", block)
    texts = corpus()
    n, comp = jaccard_components(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.components(docs(spark, texts)).collect()}
    assert got == {i: (n[i], comp[i]) for i in range(len(texts))}


def test_lone_groups_match_all_pairs(spark):
    texts = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(13)]
        texts += [" ".join(base), " ".join(base[:-1] + [f"c{g}"]), " ".join(base[:-2] + [f"h{g}", f"i{g}"])]
    n, comp = jaccard_components(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.components(docs(spark, texts)).collect()}
    assert got == {i: (n[i], comp[i]) for i in range(len(texts))}


def test_edges(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "q"], [None, 4, 4, None])
    got = sorted(((r["doc_id"], r["component_id"]) for r in J.components(df).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (None, None)], key=str)
    kept = J.one_of_each(df.withColumnRenamed("n_chars", "component_id"))
    assert sorted((r["doc_id"] is None, r["text"]) for r in kept.collect()) == [(False, "a b c d e f")] * 2 + [(True, "a b c d e f"), (True, "q")]
    assert J.components(df.limit(0)).count() == 0


def test_signature_never_drops_a_link():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(5, 900)).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 63, rng.integers(0, 40)).astype(np.uint64))))
        if not len(b):
            continue
        p, q = (np.frombuffer(J.signature(x), np.uint8) for x in (a, b))
        size = min(len(p), len(q))
        differ = np.bitwise_count(J._fold(p, size) ^ J._fold(q, size)).sum()
        assert differ <= len(np.setxor1d(a, b))


def test_one_group_families_with_any_head(spark):
    """Small groups of one prefix, of which any member may be the head, against all pairs."""
    rng = random.Random(5)
    texts = []
    for g in range(200):
        base = [f"g{g}w{i}" for i in range(rng.randint(11, 16))]
        for _ in range(rng.randint(3, 6)):
            cut = rng.randint(0, 4)
            texts.append(" ".join(base[: len(base) - cut] + [f"g{g}x{rng.randint(0, 3)}y{i}" for i in range(cut)]))
    n, comp = jaccard_components(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.components(docs(spark, texts)).collect()}
    assert got == {i: (n[i], comp[i]) for i in range(len(texts))}
    assert len(set(comp)) < len(texts) - 100


def test_links_through_null_ids_and_long_texts(spark):
    words = [f"v{i}" for i in range(30000)]
    long = " ".join(words)
    near = " ".join(words[:29000] + [f"u{i}" for i in range(400)])
    chain = [f"c{i}" for i in range(40)]
    texts = [long, near, " ".join(chain), " ".join(chain[2:] + ["d0", "d1"]), " ".join(chain[4:] + ["d0", "d1", "d2", "d3"])]
    _, comp = jaccard_components(texts)
    assert comp == [0, 0, 2, 2, 2]
    rows = J.components(docs(spark, texts, [1, 2, 3, None, 5])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(1, 1), (2, 1), (3, 3), (None, 3), (5, 3)}


def test_clashing_names_and_empty_table(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f", None, ""]).withColumnsRenamed({"lang": "near_copy", "source": "_near_copy", "n_chars": "set_key"})
    assert sorted(r["doc_id"] for r in J.one_of_each(df).collect()) == [0, 2, 3]
    assert J.one_of_each(df).columns == df.columns
    assert J.one_of_each(df.limit(0)).count() == 0
