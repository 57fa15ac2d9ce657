import hashlib

import pytest
from pyspark.sql import functions as F

from quern.llm.exact_dedup import exact_dedup, without_copies
from tests.llm.brute import AZ, docs

TEXTS = ["Hello", "hello", None, "", "É", "é", "other", "x" * 5000, "HELLO", "unique"]


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_groups(spark, limit):
    rows = exact_dedup(docs(spark, TEXTS), broadcast_bytes=limit).collect()
    groups = {}
    for i, t in enumerate(TEXTS):
        groups.setdefault((t or "").translate(AZ), []).append(i)
    for r in rows:
        text = (TEXTS[r["doc_id"]] or "").translate(AZ)
        own = groups[text]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(own), len(own), r["doc_id"] == max(own), hashlib.sha256(text.encode()).hexdigest())
    assert len(rows) == len(TEXTS)


def test_null_ids_repeats_and_clashing_columns(spark):
    df = docs(spark, ["a", "A", "b", "b", "c"], [None, 3, None, 7, 7]).withColumn("digest", F.lit(1)).withColumn("kept", F.lit("k"))
    rows = exact_dedup(df).collect()
    assert sorted((r["doc_id"] is None, r["keep_id"], r["kept"]) for r in rows) == sorted([(True, 3, False), (False, 3, True), (True, 7, False), (False, 7, True), (False, 7, True)])
    left = without_copies(df).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(3, "A"), (7, "b"), (7, "c")]
    assert set(without_copies(df).columns) == set(df.columns)


def test_repeated_rows_leave_one(spark):
    df = docs(spark, ["a", "a", "z"], [5, 5, 6])
    assert sorted((r["doc_id"], r["text"]) for r in without_copies(df).collect()) == [(5, "a"), (6, "z")]


def test_hot_group_and_empty_table(spark):
    df = docs(spark, ["same"] * 3000 + [f"t{i}" for i in range(50)])
    rows = exact_dedup(df)
    assert rows.where("kept").count() == 51 and rows.where("group_size = 3000").count() == 3000
    assert exact_dedup(df.limit(0)).count() == 0
