import random
import re

import pytest

from quern.llm import decontaminate as D
from quern.llm import license_scan as Li
from tests.llm.brute import AZ, docs


def test_license_places(spark):
    texts = [None, "", "MIT License", "the gnu general public license, the GNU General Public LICENSE v3", "CC BY-SA 4.0 and cc-by", "Apache-License apache license version 2.0", "mit  licensed", "x" * 3000, "license"]
    rows = {r["doc_id"]: r for r in Li.scan(docs(spark, texts).withColumnRenamed("lang", "labels"))[0].collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
        found = [(k, label) for phrase, label in Li.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(found), ",".join(sorted({x[1] for x in found})))
        assert (r["first_word"], r["last_word"]) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert "gpl-3.0" in rows[3]["labels"] and "cc-by-sa-4.0" in rows[4]["labels"] and "apache-2.0" in rows[5]["labels"]
    assert Li.scan(docs(spark, texts).limit(0))[0].count() == 0


def test_contained_detections_are_suppressed(spark):
    rows = Li.scan(docs(spark, ["Licensed under the Apache License, Version 2.0."]))[1].where("priority > 0").collect()
    assert [(r["label"], r["start"], r["n_words"]) for r in rows] == [("apache-2.0", 0, 8)]


def test_rules_compile():
    for _, keyword, priority, regex in Li.rules():
        assert re.compile(regex) and priority in (1, 2, 3, 4) and keyword == keyword.lower()
    assert len(Li.rules()) > 200
    for bad in ("x|mit|1|(mit|expat) license", "x|json|1|for good not evil", "x|mit|1|mit .* license"):
        with pytest.raises(ValueError):
            Li.rules(bad)


def example(regex):
    """A text that a rule matches: first alternatives, options taken."""
    while (m := re.search(r"\(([^()]*)\)", regex)) is not None:
        regex = regex[: m.start()] + m[1].split("|")[0] + regex[m.end() :]
    return regex.replace("?", "").replace("[a-z]+", "heck").replace("[0-9]+", "3")


def test_every_rule_fires_in_mid_text_and_twice(spark):
    parsed = Li.rules()
    texts = [f"some words {example(x)} and {example(x)} at the end" for _, _, _, x in parsed]
    rows = Li.scan(docs(spark, texts), rule_text=Li.RULES)[1].where("priority > 0").collect()
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append((r["start"], r["start"] + r["n_words"]))
    for i, (_, _, _, x) in enumerate(parsed):
        n = len(example(x).split())
        for place in (2, 3 + n):
            assert any(s <= place and e >= place + n for s, e in found.get(i, [])), parsed[i]


def kept_by_brute_force(text):
    """Labels and detections of a text: every rule at every word, then suppression."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(AZ))
    hits = set()
    for label, _, priority, regex in Li.rules():
        for i in range(len(w)):
            if m := re.match(f"(?:{regex})(?![^ ])", " ".join(w[i:])):
                hits.add((label, priority, i, m[0].count(" ") + 1))
    inside = lambda a, b: b[2] <= a[2] and b[2] + b[3] >= a[2] + a[3] and (b[1] < a[1] or (b[1] == a[1] and b[3] > a[3]))
    return {a for a in hits if not any(inside(a, b) for b in hits)}


def test_detections_match_every_rule_at_every_word(spark):
    rng = random.Random(3)
    pieces = [example(x) for _, _, _, x in Li.rules()] + ["zlib license and also zlib license", "gnu lesser general public license", "or", "and also", "the", "cc by", "version 3"]
    texts = ["gnu lesser general public license version 3 and gnu lesser general public license", "mozilla public license 2 0 or any mozilla public license"]
    texts += [" ".join(w for _ in range(rng.randint(1, 6)) for w in rng.choice(pieces).split()[: rng.randint(1, 30)]) for _ in range(150)]
    table, found = Li.scan(docs(spark, texts))
    got = {i: set() for i in range(len(texts))}
    for r in found.where("priority > 0").collect():
        got[r["doc_id"]].add((r["label"], r["priority"], r["start"], r["n_words"]))
    labels = {r["doc_id"]: r for r in table.collect()}
    for i, t in enumerate(texts):
        want = kept_by_brute_force(t)
        assert got[i] == want, t
        base = set(filter(None, labels[i]["base_labels"].split(",")))
        assert labels[i]["labels"] == ",".join(sorted({x[0] for x in want} | base)) and labels[i]["n_rules"] == len(want)
        assert labels[i]["score"] == max([Li.CONFIDENCE[x[1]] for x in want] + [0.9] * bool(base), default=0.0)


def overlap(item, text):
    """Whether some window of the item agrees with the text to 0.8 on some diagonal, without seeds."""
    v, w = item.lower().split(), text.lower().split()
    if len(v) < D.SPAN:
        return len(v) >= D.SHORT and any(w[i : i + len(v)] == v for i in range(len(w)))
    size = min(D.WINDOW, len(v))
    for start in range(-len(v), len(w)):
        equal = [0 <= start + j < len(w) and w[start + j] == v[j] for j in range(len(v))]
        if max(sum(equal[s : s + size]) for s in range(len(v) - size + 1)) >= D.MIN_SHARE * size - 1e-9:
            return True
    return False


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_overlaps_tolerate_substitutions(spark, limit):
    words = [f"tok{i}" for i in range(30)]
    item = " ".join(words)
    edits = {
        "whole": item,
        "two": item.replace("tok3 ", "other ").replace("tok14 ", "new "),
        "every fifth": " ".join("x" if i % 5 == 0 else w for i, w in enumerate(words)),
        "inserted": " ".join(words[:15] + ["x"] + words[15:]),
        "deleted": " ".join(words[:15] + words[16:]),
        "first part": " ".join(words[:22]),
        "last part": " ".join(words[12:]),
        "upper": item.upper(),
        "too little": " ".join(words[:9]),
        "half": " ".join("x" if i % 2 else w for i, w in enumerate(words)),
        "short": "a b c one two three four five six d",
    }
    texts = [f"before {t} after" for t in edits.values()] + [None, "", "clean text " * 20, " ".join(f"z{i}" for i in range(30000)) + " " + item]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, item), (5, "one two three four five six")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.matches(docs(spark, texts), bench, broadcast_bytes=limit).collect()}
    assert got == {(i, k) for i, t in enumerate(texts) for k, x in ((1, item), (4, item), (5, "one two three four five six")) if t and overlap(x, t)}
    assert len(got) == 2 * 9 + 1


def test_overlap_recall_at_random_substitutions(spark):
    """Against the same rule without seeds: a fifth of the tokens replaced at random."""
    rng = random.Random(8)
    items = [" ".join(f"i{k}w{j}" for j in range(rng.randint(15, 59))) for k in range(150)]
    texts = [" ".join(w if rng.random() > 0.2 else "x" for w in t.split()) for t in items]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.matches(docs(spark, texts), bench).collect()}
    want = {(i, i) for i in range(150) if overlap(items[i], texts[i])}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_clean_edges(spark):
    item = " ".join(f"tok{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = docs(spark, [item, f"a {item}", None, "", "fine", item], [None, 1, 2, 3, 4, 1]).withColumnsRenamed({"lang": "leak", "source": "words", "n_chars": "item"})
    kept = D.clean(df, bench)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "4", "None"]
    assert D.matches(df.limit(0), bench).count() == 0 and D.matches(df, bench.limit(0)).count() == 0


def overlaps(doc, item):
    """Best (n_equal, start, n_window) of an item laid at every place of a text, without seeds."""
    best = None
    for start in range(1 - len(item), len(doc)):
        equal = [0 <= start + j < len(doc) and doc[start + j] == w for j, w in enumerate(item)]
        wide = min(D.WINDOW, len(item))
        n_window = max(sum(equal[s : s + wide]) for s in range(len(item) - wide + 1))
        if n_window >= -(-D.MIN_SHARE * wide // 1) and (best is None or sum(equal) > best[0]):
            best = sum(equal), start, n_window
    return best


@pytest.mark.parametrize("broadcast_bytes", [D.BROADCAST_BYTES, 0])
def test_items_across_the_pieces_of_a_long_text(spark, broadcast_bytes):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    items = [[word() for _ in range(n)] for n in (12, 30, 90)]
    texts = []
    for item in items:
        for at in (0, D.CORE - 1, D.CORE - 7, D.CORE, 2 * D.CORE - len(item), 3 * D.CORE - len(item)):
            text = [word() for _ in range(3 * D.CORE)]
            text[at : at + len(item)] = item
            text[at + 5] = "other"
            texts.append(text)
    texts += [items[2] * 40, items[0], [word() for _ in range(2000)], []]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_equal"], r["start"], r["n_window"]) for r in D.matches(docs(spark, [" ".join(t) for t in texts]), bench, broadcast_bytes=broadcast_bytes).collect()}
    want = {(i, j): b for i, t in enumerate(texts) for j, item in enumerate(items) if (b := overlaps(t, item))}
    assert len(want) >= 20 and got == want
