"""What the command line writes of a clustering: folders of copies, documents, or lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import cluster as C
from quern.operators import export as X
from quern.operators import packing as P
from quern.plans.config import Clustering
from quern.stages import stored


def file_documents(files: DataFrame, items: DataFrame, clusters: DataFrame, names: DataFrame | None = None, pairwise: DataFrame | None = None) -> DataFrame:
    """(cluster_id, document): JSON of each cluster with its rows by file_id (``files``, from
    ``export.file_ids``): id, size, average_distance, items with file_id, average_distance and, of
    ``names``, file_name; and the distances of ``pairwise`` between file ids."""
    rows = items.join(files.select("vec_id", "file_id"), "vec_id")
    entry = [F.col("file_id"), F.round("average_distance", 6).alias("average_distance")]
    if names is not None:
        rows = rows.join(names.select("vec_id", "name"), "vec_id", "left")
        entry.append(F.col("name").alias("file_name"))
    inner = rows.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct(*entry))).alias("items"), F.min("file_id").alias("first"))
    whole = clusters.join(inner, "cluster_id")
    fields = [F.col("cluster_id").alias("id"), F.col("size"), F.round("average_distance", 6).alias("average_distance"), F.col("items")]
    if pairwise is not None:
        # places in a cluster are by vec_id, as its file ids are
        number = lambda place: (F.col("first") + place.cast("long")).cast("string")
        found = F.from_json("pairwise", "map<string,map<string,double>>")
        whole = whole.join(pairwise, "cluster_id", "left")
        fields.append(F.transform_values(F.transform_keys(found, lambda k, v: number(k)), lambda k, v: F.transform_keys(v, lambda i, d: number(i))).alias("pairwise_distances"))
    return whole.select("cluster_id", F.to_json(F.struct(*fields)).alias("document"))


def copies(df: DataFrame, assign: DataFrame, config: Clustering) -> DataFrame:
    """(path, name): where the file of each row (vec_id, path, embedding) goes: by cluster in
    folders, in groups, or in one sequence, and the discarded to unclustered/ if they are saved."""
    path = df.select("vec_id", "path")
    if config.save_mode in ("group_filling", "cluster_sort"):
        if config.save_mode == "group_filling":
            order = P.fill_groups(df, assign, config.group_filling_size, config.group_filling_split, config.similar_fill, config.threshold, config.similarity_percent / 100, config.save_discarded)
        else:
            order = P.cluster_sort(df, assign, config.group_filling_size)
        order = stored(order, "order")
        placed = order if "cluster_id" in order.columns else order.join(assign, "vec_id")
        naming = "plain" if config.naming == "default" else config.naming
        names = X.sequence_names(placed.join(df.select("vec_id", "path", "embedding"), "vec_id"), naming)
        return path.join(names, "vec_id").select("path", "name")
    known = assign.where("cluster_id is not null")
    items = stored(C.item_distances(df, known).join(path, "vec_id"), "items")
    folders = X.cluster_folders(C.cluster_distances(items), by_distance=config.naming != "default").select("cluster_id", "folder")
    if config.naming == "default":
        named = items.select("cluster_id", "vec_id", X.basename(F.col("path")).alias("name"))
    else:
        named = X.item_names(items)
    out = named.join(folders, "cluster_id").select("vec_id", F.concat_ws("/", "folder", "name").alias("name"))
    if config.save_discarded:
        loose = assign.where("cluster_id is null").join(path, "vec_id")
        out = out.unionByName(loose.select("vec_id", F.concat(F.lit("unclustered/"), X.basename(F.col("path"))).alias("name")))
    return path.join(out, "vec_id").select("path", "name")


def save(df: DataFrame, assign: DataFrame, config: Clustering, out: str) -> None:
    """Writes a clustering of (vec_id, path, embedding) to ``out`` as its save mode asks: documents
    (one row a cluster) and numbered files for "json", lines for "print", copies of the files and
    documents for all else."""
    path = df.select("vec_id", "path")
    assign = stored(assign, "assign")
    items = stored(C.item_distances(df, assign).join(path, "vec_id"), "items")
    clusters = C.cluster_distances(items)
    if config.save_mode in ("json", "print"):
        files = stored(X.file_ids(assign.join(path, "vec_id")), "files")
        if config.save_mode == "print":
            X.csv_lines(files, items).orderBy("block", "n").select("line").write.mode("overwrite").text(f"{out}/lines")
            return
        pairwise = C.pairwise_map(df, assign, config.pairwise_limit) if config.naming == "distance_plus" else None
        names = None if config.naming == "default" else X.item_names(items)
        file_documents(files, items, clusters, names, pairwise).write.mode("overwrite").parquet(f"{out}/clusters")
        files.select("file_id", "path").write.mode("overwrite").parquet(f"{out}/files")
        return
    X.copy_files(copies(df, assign, config), f"{out}/files")
    X.cluster_documents(items, clusters).write.mode("overwrite").parquet(f"{out}/clusters")
