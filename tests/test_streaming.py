import numpy as np

from quern.operators.neighbors import knn_join
from quern.streaming.find import answer_batches, stream_knn
from tests.fixtures import SCHEMA, frame


def test_stream_matches_batch(spark, tmp_path):
    df = frame(spark, np.random.default_rng(4).normal(size=(40, 4)).astype(np.float32))
    df.limit(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = stream_knn(stream, df, 3).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r["src"], r["dst"]) for r in knn_join(df, 3).where("src < 10").collect()}
    assert {(r["src"], r["dst"]) for r in spark.table("found").collect()} == want
    answer_batches(stream, df, 3, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {(r["src"], r["dst"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
