"""The query families end to end, and a command line for them.

    python -m quern.plans.run CATALOG --find QUERY:neighbors=10
    python -m quern.plans.run CATALOG --cluster algorithm=dbscan:threshold=0.4 --out DIR
    python -m quern.plans.run CATALOG --sorting strategy=dfs --out DIR

CATALOG is a Parquet table (id, filename, features).  Each task takes one group of
parameters, ``name=value`` joined by colons; --find runs last.
"""

from __future__ import annotations

import argparse
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import cluster as C
from quern.operators import neighbors as N
from quern.operators import order as O
from quern.plans.config import Clustering, Search, Sorting, with_values
from quern.plans.save import save
from quern.sources import catalog as S
from quern.sources.models import Model, load

TASKS = {"find": Search, "cluster": Clustering, "sorting": Sorting}


def cluster(df: DataFrame, config: Clustering = Clustering()) -> DataFrame:
    """(vec_id, cluster_id) by the configured algorithm, refined if asked for."""
    if config.pca:
        df = C.pca_whiten(df, config.pca_components)
    eps, least = config.threshold, config.min_size
    run = {
        "distance": lambda: C.greedy_distance(df, eps, config.similarity_percent, least),
        "hdbscan": lambda: C.hdbscan(df, least),
        "dbscan": lambda: C.dbscan(df, eps, least),
        "cc_graph": lambda: C.cc_graph(df, eps, least),
        "mutual_graph": lambda: C.mutual_graph(df, eps, least),
        "snn": lambda: C.snn(df, eps, least),
        "rank_mutual": lambda: C.rank_mutual(df, least),
        "adaptive_graph": lambda: C.adaptive_graph(df, eps, least),
        "agglomerative": lambda: C.ward(df, eps, least),
        "agglomerative_complete": lambda: C.complete_linkage(df, eps, least),
        "optics": lambda: C.optics(df, eps, least),
    }[config.algorithm]()
    return C.refine(df, run, eps, least) if config.enable_refine else run


def sort(df: DataFrame, config: Sorting = Sorting()) -> DataFrame:
    """(pos, vec_id) by the configured strategy and optimizer."""
    n = df.count()
    if n <= 1:
        return df.select(F.lit(0).cast("long").alias("pos"), "vec_id")
    order = O.dfs_order(df, config.neighbors(n)) if config.strategy == "dfs" else O.insertion_order(df)
    if config.optimizer == "2opt":
        order = O.block_two_opt(df, order, config.two_opt_block_size, config.two_opt_shift)
    return order


def _encoded(spark: SparkSession, model: Model, file: str | None = None, text: str | None = None) -> list[float]:
    """The unit vector of a file, or of a text, by a registered encoder."""
    if file is not None:
        try:
            content = spark.read.format("binaryFile").load(file).select(F.col("path").alias("filename"), "content")
        except AnalysisException:
            raise LookupError(f"{file} is neither in the catalog nor a file") from None
    else:
        content = spark.createDataFrame([("text", bytearray(text.encode()))], "filename string, content binary")
    row = S.embed(content, model.make).first()
    if row is None:
        raise LookupError(f"{model.name} gives no vector for {file or text}")
    return [float(x) for x in row["features"]]


def find(df: DataFrame, query: str, config: Search = Search(), text: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """(vec_id, path, dist): the rows nearest to a query, which is a path, a text (mode "text"), or
    a path, a tab and a text (mode "fused").

    A path in the catalog, or the one file name that equals its last part, is asked by the vector
    it has, and its own row is left out; another file, or a text, is embedded by ``model``.
    ``text`` (column embedding, optional base) gives the vector of a text instead.
    """
    spark, own = df.sparkSession, None
    path, tab, words = query.partition("\t") if config.mode == "fused" else (query, "", "")
    literal = lambda v: F.array(*[F.lit(float(x)) for x in v])
    need = lambda: model or _no_model(query)
    if config.mode == "text":
        return _nearest_to(df, literal(_encoded(spark, need(), text=query)), config, None)
    match = S.lookup(df, spark.createDataFrame([(path,)], "query string"), key="path").first()
    if match["match"] is not None:
        own = df.where(F.col("path") == match["match"]).select("vec_id", "embedding").first()
    vector = literal(own["embedding"] if own else _encoded(spark, need(), file=path))
    base = None
    if text is not None:
        row = text.first()
        said, base = row["embedding"], row["base"] if "base" in text.columns else None
    elif tab:
        said, base = _encoded(spark, need(), text=words), _encoded(spark, need(), text=config.base_prompt)
    if text is not None or tab:
        if config.fusion == "simple":
            vector = V.fuse_simple(vector, literal(said), config.image_weight, config.text_weight)
        else:
            vector = V.fuse_directional(vector, literal(said), None if base is None else literal(base), config.alpha)
    return _nearest_to(df, vector, config, own["vec_id"] if own else None)


def _no_model(query: str):
    raise LookupError(f"{query} is not in the catalog, and no encoder is named to embed it")


def _nearest_to(df: DataFrame, vector: Column, config: Search, own: int | None) -> DataFrame:
    near = N.knn_query(df, vector, config.neighbors, exclude=None if own is None else F.col("vec_id") == own)
    return near.join(df.select("vec_id", "path"), "vec_id").orderBy("dist", "vec_id")


def parse_group(text: str, config) -> tuple[str | None, object]:
    """(direct value, config) from ``[VALUE:]name=value:name=value``; the direct value may
    hold colons, as a drive or a URL does."""
    at = re.search(r"(?:^|:)(?=[A-Za-z_]\w*=)", text)
    direct, rest = (text, "") if at is None else (text[: at.start()], text[at.end() :])
    pairs = dict(part.split("=", 1) for part in re.split(r":(?=[A-Za-z_]\w*=)", rest) if part)
    return direct or None, with_values(config, pairs)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("catalog")
    parser.add_argument("--out")
    parser.add_argument("--list", action="store_true")
    parser.add_argument("--model", help="registered encoder for queries that are not in the catalog")
    for task in TASKS:
        parser.add_argument(f"--{task}", nargs="?", const="", metavar="GROUP")
    args = parser.parse_args(argv)
    args.plan = []
    for task in ("cluster", "sorting", "find"):
        if getattr(args, task) is not None:
            args.plan.append((task, *parse_group(getattr(args, task), TASKS[task]())))
    if not args.plan and not args.list:
        args.plan.append(("sorting", None, Sorting()))
    return args


def main(argv: list[str] | None = None) -> None:
    from quern.session import session

    args = arguments(argv)
    spark = session()
    known = spark.read.parquet(args.catalog)
    if args.list:
        S.listing(known).show(truncate=False)
    df = S.load_features(known)
    for task, direct, config in args.plan:
        if task == "find":
            find(df, direct, config, model=load(args.model) if args.model else None).show(truncate=False)
            continue
        result = cluster(df, config) if task == "cluster" else sort(df, config)
        if args.out and task == "sorting":
            S.save_index(result, df, f"{args.out}/index")
        elif args.out:
            save(df, result, config, args.out)
        else:
            result.show()


if __name__ == "__main__":
    main()
