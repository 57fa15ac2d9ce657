"""Nearest neighbours of a stream of query vectors against a static base.

Ranking by window is not allowed on a stream, and not needed: each query is answered from
the base alone, so the stream stays stateless and in append mode.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.neighbors import BROADCAST_BYTES, _nearest, knn_join
from quern.operators.pivots import matrix


def stream_knn(queries: DataFrame, base: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(src, dst, dist) for every row of a streaming or batch ``queries``.

    The base is broadcast behind a check of its size; a larger one is answered batch by
    batch with ``answer_batches``.
    """
    rows = base.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    size = rows.agg(F.sum(F.size("v") * 8 + 8)).first()[0] or 0
    if size > BROADCAST_BYTES:
        raise ValueError("the base is too large to broadcast; use answer_batches")
    whole = rows.toArrow()
    shared = queries.sparkSession.sparkContext.broadcast((whole.column("id").to_numpy(), matrix(whole.column("v"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for batch in batches:
            if batch.num_rows:
                src, dst, dist = _nearest(batch.column(0).to_numpy(), matrix(batch.column(1)), ids, x, k)
                yield pa.record_batch([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(dist)], names=["src", "dst", "dist"])

    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return asked.mapInArrow(run, "src long, dst long, dist double")


def answer_batches(queries: DataFrame, base: DataFrame, k: int, path: str, checkpoint: str, **columns: str):
    """Answers each micro-batch with the batch join and appends it to ``path``; rerunning a
    batch overwrites its own folder.  Returns the started query."""

    def answer(batch: DataFrame, number: int) -> None:
        knn_join(base, k, batch, **columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
