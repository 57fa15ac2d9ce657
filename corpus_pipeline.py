"""The corpus pipeline: five operators in a row, from raw documents to mixing rates.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns
a DataFrame that is written as Parquet and read again as the next stage's docs.  All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, exact_dedup, jaccard_join, langid, mixing
from quern.llm.common import remainder, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts whose language the model rejects.

    Null and empty texts are dropped.  Rows with a null id or language are judged by their text
    like any other, repeated rows stay or go together, and an empty table stays empty.
    """
    model = langid.fit(docs, sample=remainder(F.col("doc_id"), 4) != 2)
    return langid.accepted(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays.

    Null counts as an empty text, and a null id as smaller than any other.  Rows repeated with
    the same id and text leave one; an empty table stays empty.
    """
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts, the row with the smallest id stays.

    Texts without words are components of their own.  Rows with a null id stay, and so do all
    rows that share the smallest id; an empty table stays empty.
    """
    return jaccard_join.one_of_each(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap an item of the benchmark.

    Null and empty texts and rows with a null id stay; repeated rows go together; with an empty
    benchmark, or no documents, nothing is dropped.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits a rate for each document, by which its tokens count in the mix; none is dropped.

    Texts without words and rows with a null id get rows like any other, repeated rows equal
    rates, and an empty table gives an empty result.
    """
    return mixing.mix(docs, mixing.label_domains(table(spark, sf_dir, "labels")))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", decontaminate_benchmark),
    ("mix", mix_to_targets),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and components cannot be stated in SQL; tests hold each stage against a
#: brute-force version instead.
ORACLE_SQL = None
