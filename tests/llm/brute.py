"""Plain versions of the operators, over a few rows in memory."""

import collections
import hashlib
import math
import re

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, lang="en", source="s"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))


def shingle_set(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard_components(texts, percent=80):
    sets = [shingle_set(t) for t in texts]
    of = list(range(len(sets)))

    def find(a):
        while of[a] != a:
            a = of[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                of[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(a) for a in range(len(sets))]


def removed(texts, length, keep="none"):
    """(bytes, removed, spans, sha256 of the rest) by looking at every string."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.defaultdict(list)
    for d, t in enumerate(raw):
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]].append((d, i))
    out = []
    for d, t in enumerate(raw):
        mark = [False] * len(t)
        for i in range(len(t) - length + 1):
            places = seen[t[i : i + length]]
            if len(places) > 1 and (keep == "none" or places[0] != (d, i)):
                mark[i : i + length] = [True] * length
        spans = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        rest = bytes(b for b, m in zip(t, mark, strict=True) if not m)
        out.append((len(t), sum(mark), spans, hashlib.sha256(rest).hexdigest()))
    return out


def base_scores(texts, train):
    tokens = [[*words(t), "\n"] for t in texts]
    count = collections.Counter(w for ws, y in zip(tokens, train, strict=True) if y for w in ws)
    n, v = sum(count.values()), len(count)
    return [(len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for ws in tokens]
