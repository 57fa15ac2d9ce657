"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import class_lm as _lm
from quern.llm import decontaminate as _bench
from quern.llm import exact_dedup as _exact
from quern.llm import html_text as _html
from quern.llm import jaccard_join as _jaccard
from quern.llm import langid as _langid
from quern.llm import license_scan as _license
from quern.llm import manifest as _manifest
from quern.llm import mixing as _mixing
from quern.llm import quality as _quality
from quern.llm import resample as _resample
from quern.llm import suffix_dedup as _suffix
from quern.llm import topk_search as _topk
from quern.llm.common import remainder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bench.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = _langid.fit(docs, sample=~held_out)
    found = _langid.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_longest_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _suffix.remove(table(spark, sf_dir, "documents"), keep="none")
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _license.scan(table(spark, sf_dir, "documents"))[0]


def op5_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard.components(table(spark, sf_dir, "documents"))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 7) == 2
    found = _lm.score(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(table(spark, sf_dir, "documents"), _mixing.label_domains(table(spark, sf_dir, "labels")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html.main_text(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, min_words=20, buckets=10_000, run=1, seed=2024)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _manifest.manifest(docs, *_manifest.lower_thirds(docs))


def op13_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)[0]


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": _bench.SQL, "op5_jaccard_components": _jaccard.SQL, "op10_exact_dedup": _exact.SQL, "op11_importance_resampling": _resample.SQL, "op12_merkle_manifest": _manifest.SQL, "op13_pivot_topk": _topk.SQL}
