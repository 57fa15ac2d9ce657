import duckdb
import numpy as np
from pyspark.sql import functions as F

from quern.llm import html_text as H
from quern.llm import langid, mixing, quality
from tests.llm.brute import docs


def test_language_held_out(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(d, sample=~held)
    rows = langid.predict(d, model).join(d.select("doc_id", "lang"), "doc_id").where(held).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    odd = docs(spark, [None, "", "123 \u2014 \u20ac...", "é"], [1, 2, 3, None])
    got = [(r["lang_pred"], r["score"]) for r in langid.predict(odd, model).orderBy("doc_id").collect()]
    assert sum(g == ("und", 0.0) for g in got) == 3
    assert langid.accepted(odd.withColumnRenamed("lang", "score"), model).count() <= 1
    assert langid.predict(d.limit(0), model).count() == 0
    assert langid.fit(d.limit(0)) is None
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}


def test_strange_texts_are_rejected(spark, sf):
    d = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(d, sample=~held)
    rng = np.random.default_rng(0)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 300)) for _ in range(30)]
    code = ["def main(argv):\n    for i in range(len(argv)):\n        if argv[i] == 'x': print(i)\n    return foo.bar(baz)", "SELECT a.id, count(*) FROM t JOIN b USING (k) WHERE x IS NOT NULL GROUP BY 1"]
    other = ["Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства", "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan"]
    rows = langid.predict(docs(spark, noise + code + other), model).collect()
    assert np.mean([r["rejected"] for r in rows]) >= 0.95
    kept = langid.predict(d.where(held), model).agg(F.avg(F.when(F.col("rejected"), 0).otherwise(1))).first()[0]
    assert kept > 0.97


def test_mixing_meets_targets(spark, sf):
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    targets = {"good": 0.85, "poor": 0.09, "good-toxic": 0.04, "poor-toxic": 0.02}
    rows = mixing.mix(d, mixing.label_domains(labels), targets).collect()
    total = sum(r["n_tokens"] for r in rows)
    for k, share in enumerate(targets.values()):
        assert abs(sum(r["rate"] * r["n_tokens"] * r["posterior"][k] for r in rows) / total - share) < 1e-3
    assert all(r["rate"] >= 0 and abs(sum(r["posterior"]) - 1) < 1e-9 for r in rows) and len(rows) == d.count()


def test_mixing_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    odd = docs(spark, [None, "", "a b", "a b"], [None, 1, 2, 2]).withColumnRenamed("lang", "rate")
    assert mixing.mix(odd, mixing.label_domains(labels)).count() == 4
    assert mixing.mix(odd.limit(0), mixing.label_domains(labels)).count() == 0
    assert mixing.mix(odd, mixing.label_domains(labels.limit(0))).count() == 4


def test_rates_match_plain_solution(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.4, 0.4], 200)
    t = rng.integers(1, 50, 200)
    df = spark.createDataFrame([(int(n), [float(x) for x in row]) for n, row in zip(t, p, strict=True)], "n_tokens long, p array<double>")
    rate, sums = mixing.fit_rates(df, [0.8, 0.2])
    r = np.array([x[0] for x in df.select(rate).collect()])
    assert (r >= 0).all() and np.allclose((r * t) @ p, sums) and np.allclose(sums, np.array([0.8, 0.2]) * t.sum(), rtol=2e-3)


def rates(spark, t, p, targets):
    df = spark.createDataFrame([(int(n), [float(x) for x in row]) for n, row in zip(t, p, strict=True)], "n_tokens long, p array<double>")
    rate, sums = mixing.fit_rates(df, targets)
    return np.array([x[0] for x in df.select(rate).collect()]), np.array(sums)


def test_reachable_targets_are_met_to_the_tolerance(spark):
    rng = np.random.default_rng(2)
    t = rng.integers(1, 50, 300)
    p = 0.9 * np.array([0.75, 0.15, 0.07, 0.03]) + 0.1 * rng.dirichlet([0.4] * 4, 300)
    r, sums = rates(spark, t, p, goal := [0.7, 0.17, 0.09, 0.04])
    assert (r >= 0).all() and np.allclose((r * t) @ p, sums) and np.abs(sums / t.sum() - goal).max() <= 1e-6


def test_unreachable_targets_end_at_the_least_gap(spark):
    p, t, goal = np.array([[0.9, 0.1], [0.6, 0.4]] * 20), np.arange(1, 41), np.array([0.2, 0.8])
    r, sums = rates(spark, t, p, goal.tolist())
    least = abs(goal[0] * 0.4 - goal[1] * 0.6) / np.hypot(0.6, 0.4)
    assert np.allclose((r * t) @ p, sums) and np.linalg.norm(sums / t.sum() - goal) <= least + 2e-6


def test_mix_reports_its_gap(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs(spark, ["fine words", "poor text"] * 4), mixing.label_domains(labels))
    report = out.schema["rate"].metadata
    rows = out.collect()
    s = np.array([sum(r["mixed_tokens"] * r["posterior"][k] for r in rows) for k in range(4)]) / 16
    assert abs(np.linalg.norm(s - list(mixing.TARGETS.values())) - report["gap"]) < 1e-9
    assert report["stopped"] == "optimal" and 0 < report["least_gap"] <= report["gap"] <= report["least_gap"] + 1e-6


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    y = np.array(y, bool)
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_quality_on_labels_kept_from_the_fit(spark, sf):
    d, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    kept = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = quality.fit(d, labels.where(~kept))
    rows = quality.score(d, labels, classifier=model).join(labels.where(kept).withColumnRenamed("toxic", "is_toxic").withColumnRenamed("quality", "is_good"), "doc_id")
    rows = rows.where("is_good is not null and is_toxic is not null").select("quality", "toxic_score", "is_good", "is_toxic").collect()
    assert len(rows) > 500
    assert auc([r["quality"] for r in rows], [r["is_good"] for r in rows]) > 0.9
    assert auc([r["toxic_score"] for r in rows], [r["is_toxic"] for r in rows]) > 0.8


def test_quality_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = docs(spark, [None, "", "a b", "a b"], [None, 1, 1, 1]).withColumn("source", F.lit(None).cast("string")).withColumnRenamed("n_chars", "q")
    got = quality.score(odd, labels).collect()
    assert len(got) == 4 and all(0 < r["quality"] < 1 for r in got) and quality.score(odd.limit(0), labels).count() == 0


def test_a_document_is_no_evidence_for_itself(spark):
    """A lone document's prior is the corpus mean, whatever its own evidence."""
    df = docs(spark, ["good words", "bad words"] * 20).withColumn("source", F.when(F.col("doc_id") == 0, "lone").otherwise("many"))
    odds = quality.Classifier(np.zeros((1 << 20, 2), np.float32), np.zeros((quality.SHAPES, 2)), np.zeros(2))
    for w, x in (("good", 3.0), ("bad", -3.0)):
        raw = np.frombuffer(w.encode(), np.uint8)
        odds.weights[quality.word_buckets(raw, np.array([0, len(raw)]), 1 << 20)[0], 0] = x
    lone = next(r for r in quality.score(df, df.limit(0), classifier=odds).collect() if r["host"] == "lone")
    assert abs(lone["quality"] - lone["evidence"]) < 1e-9


def test_sparse_sites_shrink_to_the_mean(spark):
    text = ["good words"] * 40 + ["bad words"] * 40
    df = docs(spark, text).withColumn("source", F.when(F.col("doc_id") == 0, "lone").when(F.col("doc_id") < 40, "fine").otherwise("poor"))
    odds = quality.Classifier(np.zeros((1 << 20, 2), np.float32), np.zeros((quality.SHAPES, 2)), np.zeros(2))
    for w, x in (("good", 3.0), ("bad", -3.0)):
        raw = np.frombuffer(w.encode(), np.uint8)
        odds.weights[quality.word_buckets(raw, np.array([0, len(raw)]), 1 << 20)[0], 0] = x
    rows = {r["host"]: r["site_quality"] for r in quality.score(df, df.limit(0), classifier=odds).collect()}
    assert rows["poor"] < rows["lone"] < rows["fine"]


def test_pages(spark, sf):
    rows = {r["page_id"]: r for r in H.main_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    found = duckdb.connect().execute(f"select page_id, html from '{sf}/pages.parquet'").fetchall()
    assert len(rows) == len(found) and all(r["n_chars"] == len(r["text"]) > 0 for r in rows.values())
    odd = spark.createDataFrame([(None, "u", None), (1, None, ""), (2, "u", "<p>a &amp;  b<p>c<script>x</script>")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.main_text(odd.withColumn("text", F.lit(1))).collect()}
    assert got[None] == "" and got[1] == ""


def test_attributes_like_the_label_are_no_labels(spark):
    odd = ['data-year="2020"', "data-yield=3", 'data-youtube-id="q"', 'data-y="x"', 'data-y=""', "data-y", "data-y='1'", 'data-y="10"', 'x-data-y="1"']
    body = "<p>" + "Some long sentence of an article, with enough words to be read. " * 5 + "</p>"
    pages = [f"<body><article {a}>{body}</article></body>" for a in odd]
    assert all(set(H.Page(page).label) == {None} for page in pages)
    assert H.Page('<div class="a" data-y="1"><p data-y="0">x').label == [None, 1, 0]
    df = spark.createDataFrame([(i, "u", page) for i, page in enumerate(pages)], "page_id long, url string, html string")
    texts = {r["text"] for r in H.main_text(df).collect()}
    assert len(texts) == 1 and "Some long sentence" in texts.pop()


def test_page_model_on_unseen_layouts():
    model, wrong, n = H.default_model(), 0, 0
    for page in H.labelled_pages(60, seed=123):
        _, unary, edge = model.factors(page)
        content, _ = H.sum_product(page.parent, unary, edge)
        for node, _, _ in page.chunks:
            n += 1
            wrong += (content[node] > 0.5) != bool(page.label[node])
    assert wrong < 0.03 * n


def test_messages_match_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    parent = [-1, 0, 0, 1, 1, 2]
    unary = [tuple(x) for x in rng.uniform(0.1, 2, (6, 2)).tolist()]
    edge = [tuple(x) for x in rng.uniform(0.1, 2, (6, 4)).tolist()]
    total, on = 0.0, np.zeros(6)
    for y in itertools.product((0, 1), repeat=6):
        w = np.prod([unary[i][y[i]] for i in range(6)]) * np.prod([edge[i][2 * y[parent[i]] + y[i]] for i in range(1, 6)])
        total += w
        on += w * np.array(y)
    assert np.allclose(H.sum_product(parent, unary, edge)[0], on / total)
