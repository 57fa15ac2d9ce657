"""Names, documents and printed forms of results; files are written only by ``copy_files``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions import vectors as V
from quern.operators.ranks import quantiles
from quern.stages import stored


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]*)$", 1))


def ordered_names(order: DataFrame, n: int) -> DataFrame:
    """(pos, path, name): the position padded to the width of the last one, stem, extension."""
    width = len(str(max(n - 1, 0)))
    return order.select("pos", "path", F.concat(F.lpad(F.col("pos").cast("string"), width, "0"), F.lit("_"), stem(F.col("path")), extension(F.col("path"))).alias("name"))


def cluster_folders(clusters: DataFrame, by_distance: bool = False) -> DataFrame:
    """Adds ``folder``: cluster_001, or 001-0.1234 with the average distance."""
    number = F.lpad(F.col("cluster_id").cast("string"), 3, "0")
    name = F.concat(number, F.lit("-"), F.format_string("%.4f", "average_distance")) if by_distance else F.concat(F.lit("cluster_"), number)
    return clusters.withColumn("folder", name)


def item_names(items: DataFrame) -> DataFrame:
    """(cluster_id, vec_id, name): place in the cluster and average distance, 001-0.1234.ext;
    ``items`` has cluster_id, vec_id, path, average_distance."""
    place = F.row_number().over(W.partitionBy("cluster_id").orderBy("average_distance", "vec_id"))
    return items.select("cluster_id", "vec_id", F.concat(F.lpad(place.cast("string"), 3, "0"), F.lit("-"), F.format_string("%.4f", "average_distance"), extension(F.col("path"))).alias("name"))


def sequence_names(rows: DataFrame, naming: str = "distance", width: int = 6) -> DataFrame:
    """(pos, vec_id, name) with the distances to both neighbours in the order.

    ``rows``: pos, vec_id, path, embedding, cluster_id.  "distance" gives
    {pos}_{left}-{right}_{stem}{ext}, "distance_plus" puts the cluster first, "plain" is
    {pos}_{cluster}_{stem}{ext}.  The first left and last right distance are 0.0000.
    """
    left = rows.select((F.col("pos") + 1).alias("pos"), F.col("embedding").alias("before"))
    right = rows.select((F.col("pos") - 1).alias("pos"), F.col("embedding").alias("after"))
    both = rows.join(left, "pos", "left").join(right, "pos", "left")
    gap = lambda other: F.format_string("%.4f", F.coalesce(V.l2("embedding", other), F.lit(0.0)))
    pos, name = F.lpad(F.col("pos").cast("string"), width, "0"), F.concat(stem(F.col("path")), extension(F.col("path")))
    cluster = F.coalesce(F.col("cluster_id"), F.lit(0).cast("long")).cast("string")
    gaps = F.concat(gap("before"), F.lit("-"), gap("after"))
    parts = {"distance": [pos, gaps, name], "distance_plus": [pos, cluster, gaps, name], "plain": [pos, cluster, name]}[naming]
    return both.select("pos", "vec_id", F.concat_ws("_", *parts).alias("name"))


def file_ids(assigned: DataFrame) -> DataFrame:
    """(file_id, path): numbers from 1 in order of cluster, then id."""
    from quern.operators.cluster import ranked

    key = F.struct("cluster_id", "vec_id")
    return ranked(assigned.where("cluster_id is not null").withColumn("_key", key), "_key", "file_id").select("file_id", "vec_id", "path", "cluster_id")


def cluster_documents(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, document): JSON of each cluster; one row a cluster, so no document holds
    more than its own members."""
    inner = items.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "path", F.round("average_distance", 6).alias("average_distance")))).alias("items"))
    whole = cluster_folders(clusters).join(inner, "cluster_id")
    return whole.select("cluster_id", F.to_json(F.struct(F.col("cluster_id").alias("id"), "size", F.col("folder").alias("folder_name"), F.round("average_distance", 6).alias("average_distance"), "items")).alias("document"))


def summary_document(documents: DataFrame, discarded: DataFrame, **run: object) -> DataFrame:
    """One JSON document of a clustering: its parameters, clusters and discarded paths.

    It is one document, so it holds all clusters; ``cluster_documents`` scales further.
    """
    listed = documents.agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("cluster_id", "document"))), lambda s: s["document"])).alias("c"), F.count(F.lit(1)).alias("n"))
    rest = discarded.agg(F.to_json(F.array_sort(F.collect_list("path"))).alias("d"), F.count(F.lit(1)).alias("m"))
    head = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in run.items()])) if run else F.lit("{}")
    return listed.join(F.broadcast(rest)).select(
        F.concat(F.lit('{"run":'), head, F.lit(',"cluster_count":'), F.col("n").cast("string"), F.lit(',"discarded_count":'), F.col("m").cast("string"), F.lit(',"clusters":['), F.col("c"), F.lit('],"discarded_paths":'), F.col("d"), F.lit("}")).alias("document")
    )


def csv_lines(files: DataFrame, items: DataFrame) -> DataFrame:
    """(block, n, line): a file block "path,file_id" and a cluster block
    "cluster_001,size,averageDist=0.1234,file_id,0.1234,..."."""
    first = files.select(F.lit(1).alias("block"), F.col("file_id").alias("n"), F.concat_ws(",", "path", F.col("file_id").cast("string")).alias("line"))
    joined = items.join(files.select("vec_id", "file_id"), "vec_id")
    inner = joined.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.avg("average_distance").alias("mean"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("file_id", "average_distance"))), lambda s: F.concat(s["file_id"].cast("string"), F.lit(","), F.format_string("%.4f", s["average_distance"])))).alias("rest")
    )
    name = F.concat(F.lit("cluster_"), F.lpad(F.col("cluster_id").cast("string"), 3, "0"))
    second = inner.select(F.lit(2).alias("block"), F.col("cluster_id").alias("n"), F.concat_ws(",", name, F.col("size").cast("string"), F.concat(F.lit("averageDist="), F.format_string("%.4f", "mean")), "rest").alias("line"))
    return first.unionByName(second)


def size_stats(assign: DataFrame) -> DataFrame:
    """Number of clusters, smallest, median and largest size, and number discarded."""
    sizes = assign.where("cluster_id is not null").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    sizes = stored(sizes, "sizes")
    stats = sizes.agg(F.count(F.lit(1)).alias("n_clusters"), F.min("size").alias("min_size"), F.max("size").alias("max_size"))
    stats = stats.join(F.broadcast(quantiles(sizes, "size", {"median_size": 0.5}))).select("n_clusters", "min_size", "median_size", "max_size")
    return stats.join(F.broadcast(assign.agg(F.count(F.when(F.col("cluster_id").isNull(), 1)).alias("n_discarded"))))


def window_neighbors(rows: DataFrame, n: int) -> DataFrame:
    """(pos, neighbors): the n positions before (near to far), then the n after, with
    distances to six places."""
    shifts = F.explode(F.array(*[F.lit(j) for j in (*range(-1, -n - 1, -1), *range(1, n + 1))])).alias("j")
    wanted = rows.select("pos", "embedding", shifts).withColumn("q", F.col("pos") + F.col("j"))
    near = wanted.join(rows.select(F.col("pos").alias("q"), F.col("embedding").alias("other")), "q")
    item = F.concat(F.col("q").cast("string"), F.lit(":"), F.format_string("%.6f", V.l2("embedding", "other")))
    key = F.struct((F.col("j") > 0).alias("side"), F.abs("j").alias("away"), item.alias("item"))
    return near.groupBy("pos").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(key)), lambda s: s["item"])).alias("neighbors"))


def copy_files(names: DataFrame, target: str) -> None:
    """Copies ``path`` to ``target``/``name`` from the executors; both must be reachable
    there.  Repeating it after a lost executor overwrites with the same content."""

    def run(rows) -> None:
        import os
        import shutil

        for r in rows:
            to = os.path.join(target, r["name"])
            os.makedirs(os.path.dirname(to), exist_ok=True)
            shutil.copyfile(r["path"], to)

    names.select("path", "name").foreachPartition(run)
