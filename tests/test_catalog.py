import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import cluster as C
from quern.operators import export as X
from quern.plans import config as Cf
from quern.plans import run as R
from quern.sources import catalog as S
from quern.sources import models
from tests.fixtures import frame, planted


def test_scan_embed_and_increment(spark, tmp_path):
    for name in ("a.JPG", "b.png", "c.txt"):
        (tmp_path / name).write_bytes(name.encode() * 3)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.jpg").write_bytes(b"x")
    found = S.scan_images(spark, str(tmp_path))
    names = sorted(r["filename"].rsplit("/", 1)[1] for r in found.collect())
    assert names == ["a.JPG", "b.png"]
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.png").select(F.col("path").alias("filename"), "content")
    rows = S.embed(files, models.load("byte_histogram").make).collect()
    assert len(rows) == 1 and abs(np.linalg.norm(rows[0]["features"]) - 1) < 1e-6
    with pytest.raises(KeyError):
        models.load("none")


def test_paths(spark):
    df = spark.createDataFrame([(' "a\\b//c/./d/" ',), ("./x",), ("'q'",)], "p string")
    assert [r[0] for r in df.select(S.normalized_path(F.col("p"))).collect()] == ["a/b/c/d", "x", "q"]


def test_rebase_and_lookup(spark):
    known = spark.createDataFrame([("/old/a.jpg",), ("/old/b.jpg",), ("/other/c.jpg",), ("/new/b.jpg",)], "filename string")
    found = spark.createDataFrame([("/new/a.jpg",)], "filename string")
    got = {r["filename"]: r["status"] for r in S.rebased(known, "/old", "/new", found).collect()}
    assert got == {"/old/a.jpg": "moved", "/old/b.jpg": "skipped", "/other/c.jpg": "skipped", "/new/b.jpg": "skipped"}
    asked = spark.createDataFrame([("/old/a.jpg",), ("C.JPG",), ("b.jpg",), ("zzz",)], "query string")
    got = {r["query"]: (r["match"], r["kind"]) for r in S.lookup(known, asked).collect()}
    assert got == {"/old/a.jpg": ("/old/a.jpg", "exact"), "C.JPG": ("/other/c.jpg", "name"), "b.jpg": (None, "external"), "zzz": (None, "external")}


def test_query_lines(spark):
    df = spark.createDataFrame([("a.jpg\tred",), ("",), ("  ",), ("nothing",), ("\tx",)], "value string")
    assert [tuple(r) for r in S.parse_queries(df, fused=True).collect()] == [("a.jpg", "red")]
    assert S.parse_queries(df).count() == 3


def test_width_check_and_index(spark, tmp_path):
    bad = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [1.0, 2.0])], "id long, filename string, features array<float>")
    with pytest.raises(ValueError):
        S.load_features(bad)
    df = frame(spark, np.eye(3))
    S.save_index(df.selectExpr("vec_id pos", "vec_id"), df, str(tmp_path / "index"))
    assert S.load_index(spark, str(tmp_path / "index")).count() == 3


def test_documents(spark):
    x, label = planted()
    df = frame(spark, x, label).withColumn("path", F.concat(F.lit("/in/"), F.col("vec_id").cast("string"), F.lit(".jpg")))
    assign = C.cc_graph(df, 0.35, 2)
    items = C.item_distances(df, assign).join(df.select("vec_id", "path"), "vec_id")
    docs = X.cluster_documents(items, C.cluster_distances(items))
    whole = X.summary_document(docs, df.join(assign.where("cluster_id is null"), "vec_id"), algorithm="cc_graph", threshold=0.35).first()[0]
    read = json.loads(whole)
    assert read["cluster_count"] == 4 and read["discarded_count"] == 5 and len(read["discarded_paths"]) == 5
    assert sum(c["size"] for c in read["clusters"]) == 64 and read["run"]["algorithm"] == "cc_graph"
    files = X.file_ids(df.join(assign, "vec_id"))
    lines = X.csv_lines(files, items).orderBy("block", "n").collect()
    assert len(lines) == 64 + 4 and lines[-1]["line"].startswith("cluster_004,30,averageDist=0.")


def test_config_and_grammar():
    assert Cf.Clustering(algorithm="graph").algorithm == "cc_graph"
    assert Cf.Clustering(algorithm="x", similarity_percent=900, min_size=0).similarity_percent == 100
    direct, config = R.parse_group("C:/a b.jpg:neighbors=10:alpha=0.2", Cf.Search())
    assert direct == "C:/a b.jpg" and config.neighbors == 10 and config.alpha == 0.2
    with pytest.raises(ValueError):
        R.parse_group("nope=1", Cf.Search())
    plan = R.arguments(["cat", "--find", "q.jpg:neighbors=3", "--cluster", "algorithm=dbscan"]).plan
    assert [p[0] for p in plan] == ["cluster", "find"]
    assert [p[0] for p in R.arguments(["cat"]).plan] == ["sorting"]


def test_find(spark):
    x, label = planted()
    df = frame(spark, x, label).withColumn("path", F.concat(F.lit("/in/"), F.col("vec_id").cast("string"), F.lit(".jpg")))
    rows = R.find(df, "0.jpg", Cf.Search(neighbors=3)).collect()
    assert len(rows) == 3 and all(label[r["vec_id"]] == 0 and r["vec_id"] != 0 for r in rows)
    with pytest.raises(LookupError):
        R.find(df, "none.jpg")


def test_find_what_is_not_in_the_catalog(spark, tmp_path):
    from quern.sources.models import load

    for i in range(6):
        (tmp_path / f"q{i}.jpg").write_bytes(bytes([16 * i] * 8 + [16 * i + 16] * i))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    made = S.embed(files.withColumnRenamed("path", "filename"), S.byte_histogram)
    df = made.select(F.regexp_extract("filename", r"q(\d)", 1).cast("long").alias("vec_id"), F.col("filename").alias("path"), F.col("features").alias("embedding"))
    known, model = df.where("vec_id <> 2").cache(), load("byte_histogram")
    rows = R.find(known, str(tmp_path / "q2.jpg"), Cf.Search(neighbors=2), model=model).collect()
    assert len(rows) == 2 and rows[0]["vec_id"] == 3
    text = R.find(known, "000", Cf.Search(neighbors=1, mode="text"), model=model).collect()  # bytes 0x30
    assert text[0]["vec_id"] == 3
    for fusion in ("simple", "directional"):
        both = R.find(known, f"{tmp_path}/q0.jpg\t@@@@", Cf.Search(neighbors=5, mode="fused", fusion=fusion, image_weight=0.1, text_weight=0.9, alpha=5.0), model=model).collect()
        assert both[0]["vec_id"] == 4 and all(r["vec_id"] != 0 for r in both)
    with pytest.raises(LookupError):
        R.find(known, str(tmp_path / "q2.jpg"))
    with pytest.raises(LookupError):
        R.find(known, str(tmp_path / "none.jpg"), model=model)


def test_lookup_of_urls_as_given(spark):
    known = spark.createDataFrame([("http://a/x/1/",), ("http://b/2",), ("http://b/3/",)], "url string")
    asked = spark.createDataFrame([("http://a/x/1",), ("http://c/2/",), ("http://b/3/",), ("http://c/2",)], "query string")
    got = {r["query"]: (r["match"], r["kind"]) for r in S.lookup(known, asked, "url", clean=S.as_given).collect()}
    assert got == {"http://a/x/1": (None, "external"), "http://c/2/": (None, "external"), "http://b/3/": ("http://b/3/", "exact"), "http://c/2": ("http://b/2", "name")}
