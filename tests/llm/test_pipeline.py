import corpus_pipeline
from tests.llm.brute import jaccard_components


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "decontaminate", "mix"]
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    langs, exact, near, clean = seen
    assert len(langs) > 0.97 * len(rows)
    latest = {}
    for i in sorted(langs):
        latest[rows[i].lower() if rows[i].isascii() else rows[i]] = i
    assert exact == set(latest.values())
    order = sorted(exact)
    comp = jaccard_components([rows[i] for i in order])[1]
    assert near == {i for k, i in enumerate(order) if comp[k] == k}
    assert clean <= near
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in mixed.collect()} == clean
