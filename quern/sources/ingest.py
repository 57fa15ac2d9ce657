"""Incremental ingest: new and changed files of a folder, or rows of a stream, into a catalog.

The catalog is cut in buckets by key.  A batch reads only the buckets that it touches, keeps
the latest row of each key, writes these buckets anew and commits them as one version; other
buckets are carried over by name.  A batch that is run again, after a crash between commit and
checkpoint, finds its rows there already and changes nothing but the version number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.ranks import positions
from quern.sources import versions
from quern.sources.catalog import Encoder, embed, is_image, plain_path, upsert
from quern.stages import stored

BUCKETS, TRIES = 64, 10


def upsert_version(new: DataFrame, path: str, key: str = "filename", version: str = "version", buckets: int = BUCKETS) -> int | None:
    """Commits the latest row of each key, by ``version`` and then for the new one, to the catalog
    at ``path``; returns the version's number, None if there was nothing to add.

    Keys of one batch must have one row for each version.  Where another writer commits first,
    the batch is merged again with what that one wrote.
    """
    spark, schema = new.sparkSession, new.schema
    rows = stored(new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "batch")
    touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())
    if not touched:
        return None
    for _ in range(TRIES):
        after = versions.last(spark, path)
        parts = versions.current(spark, path)
        old = [parts[str(b)] for b in touched if str(b) in parts]
        known = spark.read.schema(schema).parquet(*old) if old else rows.limit(0).drop("bucket")
        merged = upsert(known, rows.drop("bucket"), key, version)
        folder = versions.new_folder(path)
        named = merged.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        named.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(folder)
        try:
            return versions.commit(spark, path, parts | {str(b): f"{folder}/bucket={b}" for b in touched}, after)
        except FileExistsError:
            continue
    raise FileExistsError(f"{TRIES} other writers committed to {path} first")


def read_version(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the last whole version; none if there is no version yet."""
    parts = versions.current(spark, path)
    return spark.read.schema(schema).parquet(*parts.values()) if parts else spark.createDataFrame([], schema)


def with_ids(catalog: DataFrame, key: str = "filename") -> DataFrame:
    """Adds ``id``, the place of the key among all keys."""
    return positions(catalog, [], [key], "id")


def ingest_stream(rows: DataFrame, path: str, checkpoint: str, key: str = "filename", version: str = "version", buckets: int = BUCKETS, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Starts adding the batches of a stream to a catalog, each ``prepare``d first, until what is
    there now is done."""

    def add(batch: DataFrame, number: int) -> None:
        upsert_version(batch if prepare is None else prepare(batch), path, key, version, buckets)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_images(spark: SparkSession, folder: str, path: str, checkpoint: str, encoder: Callable[[], Encoder], buckets: int = BUCKETS, files: int = 1024) -> StreamingQuery:
    """Starts embedding the images of a folder that no earlier run with this checkpoint took, in
    batches of ``files``, into a catalog (filename, features, version)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files).load(folder)
    rows = found.where(is_image("path")).select(plain_path("path").alias("filename"), F.col("modificationTime").alias("version"), "content")

    def prepare(batch: DataFrame) -> DataFrame:
        return embed(batch, encoder).join(batch.select("filename", "version"), "filename")

    return ingest_stream(rows, path, checkpoint, buckets=buckets, prepare=prepare)
