import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quern.llm import manifest as M
from tests.llm.brute import AZ, SCHEMA


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    doc_id, text, lang, source, n_chars = row
    return digest(*map(field, (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The levels from the nodes up to one."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, at):
    """(left, right) of each ancestor's run."""
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        yield run[: at % 8], run[at % 8 + 1 :]
        at //= 8


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault("n" if r[2] is None else "s" + r[2], []).append(r)
    trees = {}
    for g, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = climb([leaf(r) for r in members])
    names = sorted(trees, key=lambda g: g.encode())
    top = climb([trees[g][-1][0] for g in names])
    root = top[-1][0]
    out = []
    for g, members in groups.items():
        for at, r in enumerate(members):
            steps = [*siblings(trees[g], at), *siblings(top, names.index(g))]
            doc_id, text = r[0], r[1]
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                text = None if text is None else text.translate(AZ)
            folded = leaf((doc_id, text, *r[2:]))
            for left, right in steps:
                folded = digest(*left, folded, *right)
            proof = digest(*[h for left, right in steps for h in left + right])
            out.append((doc_id, leaf(r), trees[g][-1][0], root, proof, folded, folded == root))
    return out


def held(rows):
    return sorted(map(str, map(tuple, rows)))


def run(spark, rows, levels=4):
    df = spark.createDataFrame(rows, SCHEMA)
    return M.manifest(df, *M.lower_thirds(df), fan_levels=levels)


def some(n, lang):
    return [(1000 * len(lang or "") + i, f"Text {i} of {lang}" if i % 5 else f"text {i}", lang, "s", i) for i in range(n)]


@pytest.mark.parametrize("levels", [1, 4])
def test_every_shape_of_tree(spark, levels):
    rows = [r for n, lang in ((1, None), (2, "b"), (8, "cc"), (9, "ddd"), (64, "eeee"), (65, "fffff"), (150, "gggggg"), (17, "é"), (3, ""), (5, "Z")) for r in some(n, lang)]
    got = run(spark, rows, levels).collect()
    assert held(got) == held(brute(rows))
    assert 0 < sum(not r["verified"] for r in got) < len(rows) / 3


def test_odd_rows(spark):
    rows = [(None, "A", "en", None, None), (3, None, None, "s", 1), (3, None, None, "s", 1), (3, "", None, "", 0), (7, "É 漢字\n" * 50000, "en", "ünï", -5), (9, "-", "-", "-", 1), (12, "X", "en", "s", None)]
    assert held(run(spark, rows).collect()) == held(brute(rows))


@pytest.mark.parametrize("n", [0, 1])
def test_tiny(spark, n):
    rows = some(1, "en")[:n]
    got = run(spark, rows).collect()
    assert held(got) == held(brute(rows) if rows else [])
    if n:
        assert got[0]["root"] == got[0]["leaf"] and got[0]["proof_sha256"] == hashlib.sha256(b"").hexdigest()


def test_many_languages_and_clashing_columns(spark):
    rows = [(i, f"T{i}", f"l{i % 70}", "s", 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("h", "t", "n", "pos", "leaf", "root", "id", "at", "odd")})
    assert held(M.manifest(df, *M.lower_thirds(df), fan_levels=1).collect()) == held(brute(rows))


def test_an_unchanged_table_verifies(spark, sf):
    rows = M.manifest(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert rows and all(r["verified"] for r in rows) and len({r["root"] for r in rows}) == 1
