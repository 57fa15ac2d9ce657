import math

import numpy as np

from pyspark.sql import functions as F

from quern.functions import vectors as V


def test_norm_of_zero_and_unit(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    rows = df.select(V.norm("v").alias("n"), V.normalize("v").alias("u")).collect()
    assert [r["n"] for r in rows] == [0.0, 5.0]
    assert rows[0]["u"] == [0.0, 0.0] and rows[1]["u"] == [0.6, 0.8]


def test_fusion_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    r = df.select(V.fuse_simple("a", "b", -1, 0).alias("s"), V.fuse_directional("a", "b").alias("d"), V.fuse_directional("a", "b", F.col("b"), 1.0).alias("same")).first()
    assert [round(x, 6) for x in r["s"]] == [round(math.sqrt(0.5), 6)] * 2
    n = math.hypot(1, 0.7)
    assert [round(x, 6) for x in r["d"]] == [round(1 / n, 6), round(0.7 / n, 6)]
    assert [round(x, 6) for x in r["same"]] == [round(math.sqrt(0.5), 6)] * 2


def test_crops(spark):
    df = spark.createDataFrame([(100, 100), (150, 100), (100, 200)], "w int, h int")
    assert [len(r[0]) for r in df.select(V.crop_boxes("w", "h")).collect()] == [1, 2, 3]
    r = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]],)], "v array<array<double>>").select(V.average_crops("v").alias("m")).first()
    assert [round(x, 6) for x in r["m"]] == [round(math.sqrt(0.5), 6)] * 2


def test_sql_functions(spark):
    V.register(spark)
    assert spark.sql("select l2_distance(array(0D, 0D), array(3D, 4D)) d").first()["d"] == 5.0


def test_unlike_lengths_are_null(spark):
    assert spark.sql("select array(1D) a, array(1D, 2D) b").select(V.l2("a", "b").alias("d")).first()["d"] is None


def test_knn_as_a_table_function(spark):
    from quern.functions.vectors import register_knn

    x = np.random.default_rng(6).normal(size=(30, 3))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(99, None)], "vec_id long, embedding array<double>")
    register_knn(df, "near")
    q = [0.1, -0.2, 0.3]
    want = np.argsort(np.linalg.norm(x - q, axis=1), kind="stable")[:5].tolist()
    found = spark.sql(f"SELECT * FROM near(array({', '.join(f'{z}D' for z in q)}), 5) ORDER BY rank")
    assert [(r["rank"], r["vec_id"]) for r in found.collect()] == list(enumerate(want, 1))
    assert "TakeOrderedAndProject" in found._jdf.queryExecution().executedPlan().toString()
    both = spark.sql("SELECT q.vec_id AS src, n.vec_id AS dst FROM near_index q, LATERAL near(q.v, 2) n WHERE q.vec_id = 3")
    assert sorted(r["dst"] for r in both.collect())[:1] and len(both.collect()) == 2


def test_fusion_work_is_in_proportion_to_the_width(spark):
    import time

    x = np.random.default_rng(1).normal(size=(3, 40, 400))
    df = spark.createDataFrame([(a, b, c) for a, b, c in zip(*x.tolist(), strict=True)], "a array<double>, b array<double>, c array<double>")
    began = time.time()
    got = np.array([r[0] for r in df.select(V.fuse_directional("a", "b", F.col("c"))).collect()])
    assert time.time() - began < 20
    step = x[1] - x[2]
    want = x[0] + 0.7 * step / np.linalg.norm(step, axis=1, keepdims=True)
    assert np.allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-12)


def test_table_function_query_takes_one_row_against_all(spark, sf):
    from quern.plans import queries as Q

    plan = Q.queries()["knn_table_function"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "TakeOrderedAndProject" in plan


def test_rounding_to_zero_keeps_the_sign(spark):
    x = [-4e-7, 4e-7, -0.0, 0.0, -1.25e-6, 2.5e-6, None]
    df = spark.createDataFrame([(x,)], "x array<double>")
    got = df.select(F.transform("x", lambda z: V.rounded(z))).first()[0]
    assert [str(v) for v in got] == ["-0.0", "0.0", "-0.0", "0.0", "-1e-06", "3e-06", "None"]


def test_fused_zeros_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from quern.plans import queries as Q

    x = [[-1e-7] + [1.0] * 63, [-2e-7] + [1.0] * 63]
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = Q.queries()["fuse_simple"](spark, str(tmp_path)).first()["fused"]
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = c.execute(Q.oracle_sql()["fuse_simple"]).fetchone()[1]
    assert list(map(str, got)) == list(map(str, want)) and str(got[0]) == "-0.0"
