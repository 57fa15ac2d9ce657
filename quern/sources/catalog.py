"""The feature catalog: a table (id, filename, features) of vectors by file.

Scans, increments, upserts, path rewrites and lookups are DataFrame joins; a folder of
images is read with Spark's binaryFile source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.sources import versions

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp", "jfif")


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, length, modified) of the images right under a folder, content unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return files.where(is_image("path")).select(plain_path("path").alias("filename"), "length", F.col("modificationTime").alias("modified"))


def is_image(path: str) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(IMAGE_SUFFIXES) + r")$")


def plain_path(path: str) -> Column:
    """A path without the scheme of local files."""
    return F.regexp_replace(path, r"^file:/+", "/")


def normalized_path(path: Column) -> Column:
    """Without outer blanks and matching quotes, with single forward slashes, no "." parts,
    and no trailing slash."""
    p = F.trim(path)
    p = F.regexp_replace(p, r"""^(["'])(.*)\1$""", "$2")
    p = F.regexp_replace(F.regexp_replace(p, r"\\", "/"), r"(?<!:)/{2,}", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"(?<=/)(\./)+", ""), r"^\./", "")
    return F.regexp_replace(p, r"(?<=.)/+$", "")


def as_given(path: Column) -> Column:
    return path


def new_files(found: DataFrame, known: DataFrame, key: str = "filename") -> DataFrame:
    """Files that are not in the catalog yet."""
    return found.join(known.select(key), key, "left_anti")


def live(known: DataFrame, found: DataFrame, key: str = "filename") -> DataFrame:
    """Catalog rows whose file is still there."""
    return known.join(found.select(key), key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str = "filename", version: str = "version") -> DataFrame:
    """The latest row of each key; of equal versions, the one from ``new``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(version), F.desc("_new")))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_new")


def listing(known: DataFrame) -> DataFrame:
    return known.select("filename").orderBy("id") if "id" in known.columns else known.select("filename").orderBy("filename")


def load_features(known: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(vec_id, path, embedding) of live rows; raises if vectors differ in length."""
    rows = known if found is None else live(known, found)
    widths = rows.agg(F.min(F.size("features")).alias("a"), F.max(F.size("features")).alias("b")).first()
    if widths["a"] != widths["b"]:
        raise ValueError(f"vectors of {widths['a']} and {widths['b']} numbers in one catalog")
    return rows.select(F.col("id").cast("long").alias("vec_id"), F.col("filename").alias("path"), F.col("features").alias("embedding"))


def rebased(known: DataFrame, old_root: str, new_root: str, found: DataFrame | None = None, key: str = "filename") -> DataFrame:
    """Adds ``new_path`` and ``status``: moved, skipped (outside the root, or the new path is
    taken), or missing (no file at the new path, if ``found`` tells)."""
    old, new = (r if r.endswith("/") else r + "/" for r in (old_root, new_root))
    to = F.when(F.col(key).startswith(old), F.concat(F.lit(new), F.substring(F.col(key), F.lit(len(old) + 1), F.length(key))))
    rows = known.withColumn("new_path", to)
    taken = known.select(F.col(key).alias("_taken")).distinct()
    rows = rows.join(taken, F.col("new_path") == F.col("_taken"), "left")
    missing = F.lit(False)
    if found is not None:
        there = found.select(F.col(key).alias("_there")).distinct()
        rows = rows.join(there, F.col("new_path") == F.col("_there"), "left")
        missing = F.col("_there").isNull()
    status = F.when(F.col("new_path").isNull() | F.col("_taken").isNotNull(), "skipped").when(missing, "missing").otherwise("moved")
    return rows.withColumn("status", status).drop("_taken", "_there")


def lookup(known: DataFrame, queries: DataFrame, key: str = "filename", query: str = "query", clean: Callable[[Column], Column] = normalized_path) -> DataFrame:
    """(query, match, kind): the row with the same path, else the only row with the same
    file name, else none ("external").

    Paths are compared as ``clean`` leaves them; of URLs, where a slash at the end counts, nothing
    is to be cleaned (``as_given``)."""
    from quern.operators.export import basename

    exact = known.select(F.col(key).alias("_path"), clean(F.col(key)).alias("_exact")).dropDuplicates(["_exact"])
    names = known.select(F.col(key).alias("_only"), F.lower(basename(F.col(key))).alias("_name"))
    only = names.groupBy("_name").agg(F.count(F.lit(1)).alias("_c"), F.min("_only").alias("_only")).where("_c = 1")
    q = queries.select(query, clean(F.col(query)).alias("_q"), F.lower(basename(clean(F.col(query)))).alias("_b"))
    both = q.join(exact, F.col("_q") == F.col("_exact"), "left").join(only, F.col("_b") == F.col("_name"), "left")
    kind = F.when(F.col("_path").isNotNull(), "exact").when(F.col("_only").isNotNull(), "name").otherwise("external")
    return both.select(query, F.coalesce("_path", "_only").alias("match"), kind.alias("kind"))


def save_index(order: DataFrame, df: DataFrame, path: str) -> int:
    """Writes (pos, vec_id, path, embedding), which a search needs, as a new version of the
    index; readers see it once it is whole.  Returns the version's number."""
    spark, columns = df.sparkSession, ["vec_id", "embedding", *(["path"] if "path" in df.columns else [])]
    folder, after = versions.new_folder(path), versions.last(spark, path)
    order.join(df.select(*columns), "vec_id").write.parquet(folder)
    return versions.commit(spark, path, {"index": folder}, after)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version of the index."""
    return spark.read.parquet(versions.current(spark, path)["index"])


def parse_queries(lines: DataFrame, column: str = "value", fused: bool = False) -> DataFrame:
    """(image, text) of query lines: a path or a text, or "path<TAB>text" when fused.

    Blank lines are left out, as are fused lines without a tab or with an empty half.
    """
    text = F.trim(F.col(column))
    rows = lines.where(F.length(text) > 0)
    if not fused:
        return rows.select(text.alias("image"), F.lit(None).cast("string").alias("text"))
    parts = F.split(F.col(column), "\t", 2)
    return rows.select(F.trim(F.get(parts, F.lit(0))).alias("image"), F.trim(F.get(parts, F.lit(1))).alias("text")).where("text is not null and image <> '' and text <> ''")


Encoder = Callable[[bytes], list[float]]


def embed(files: DataFrame, encoder: Callable[[], Encoder], column: str = "content") -> DataFrame:
    """(filename, features): unit vectors of file contents.

    ``encoder`` makes the function that embeds one content; it is called once a task, so a
    model is loaded once.  Contents it fails on (an exception or None) give no row.
    """
    import pandas as pd

    def run(batches):
        make = encoder()
        for pdf in batches:
            names, out = [], []
            for name, content in zip(pdf["filename"], pdf["content"], strict=True):
                try:
                    v = make(bytes(content))
                except Exception:  # an unreadable file is skipped, like a missing one
                    v = None
                if v is not None:
                    names.append(name)
                    out.append([float(x) for x in v])
            yield pd.DataFrame({"filename": names, "features": out})

    from quern.functions.vectors import normalize

    rows = files.select("filename", F.col(column).alias("content")).mapInPandas(run, "filename string, features array<double>")
    return rows.select("filename", normalize("features").cast("array<float>").alias("features"))


def byte_histogram() -> Encoder:
    """A toy encoder for tests: counts of bytes by their upper four bits."""

    def run(content: bytes) -> list[float]:
        out = [0.0] * 16
        for b in content:
            out[b >> 4] += 1
        return out

    return run
