"""Stored stages: intermediate results written to the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir).

    Where it is unset, a session in one process may use the temporary folder of its machine; a
    cluster has no folder that surely is shared, and raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return base or os.path.join(tempfile.gettempdir(), "quern-checkpoints")


_written: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a stage to the shared folder and reads it back.

    Lineage ends here, on files that outlive any executor, and what several later
    branches read is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(stage: DataFrame) -> None:
    """Deletes one stored stage, which nothing may read any more."""
    files = stage.inputFiles()
    for i, (spark, path) in enumerate(_written):
        if files and f"/{os.path.basename(path)}/" in files[0]:
            del _written[i]
            _delete(spark, path)
            return


def release(keep: int = 0) -> None:
    """Deletes all stored stages but the first ``keep``; results that still read them become
    unreadable."""
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at exit; the folder is scratch space
            return


@contextmanager
def scope() -> Iterator[None]:
    """Stages stored inside are deleted at its end, so a long session keeps none of them; results
    must be written or collected by then."""
    kept = len(_written)
    try:
        yield
    finally:
        release(kept)


atexit.register(release)
