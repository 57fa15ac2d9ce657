"""Importance resampling towards a target corpus.

Every feature of a document (a run of words) falls in one of a fixed number of buckets.
Counts of the buckets in the corpus and in the target give each bucket an integer gain; the
gains are one array of bounded size, and the weight of a document is the mean of its
features' gains.  A fixed pseudo-random (Gumbel) number is added, so the highest scores are
a draw without replacement in proportion to exp(weight / 1000).

Scores are integers, so the draw needs no sort of the corpus: a histogram of scores, summed
up from the highest score down, gives the score that the last drawn row has and the rank
before each score; only rows at or above it are shuffled, by score, and numbered by id
within their score.  Since the pseudo-random part spreads ids over thousands of scores, no
score holds more than about one in 2,700 of the ids (the largest mass of one integer of that
distribution), however alike their texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm.common import ascii_lower, crc_sql, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bucket counts travel to the driver as one array; this bounds it to a few MB.
MAX_BUCKETS = 1 << 20


def features(docs: DataFrame, buckets: int, run: int, text_col: str, *keep: Column) -> DataFrame:
    """(.., n_words, features): the buckets of all runs of 1 to ``run`` words, with repeats."""
    rows = docs.select(*keep, F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(WORD), F.lit(0)).alias("words"))

    def of(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % buckets).cast("int")

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("words") - (n - 1))
        joined = F.transform(starts, lambda i: of(F.array_join(F.slice("words", i, n), " ")))
        return F.when(F.size("words") >= n, joined).otherwise(F.array().cast("array<int>"))

    parts = [F.transform("words", of), *(runs(n) for n in range(2, run + 1))]
    return rows.withColumn("n_words", F.size("words").cast("long")).withColumn("features", F.concat(*parts)).drop("words")


def bucket_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n) over all rows; at most one row a bucket and task is shuffled."""
    return rows.select(F.explode("features").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """For each bucket floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))), from two tables (bucket, n)."""
    s, t = F.coalesce("s", F.lit(0)).cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    total = lambda df, name: df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(name)).first()[0]
    all_s, all_t = total(corpus, "s") + buckets, total(target, "t") + buckets
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    gain = F.floor(1000 * F.ln((t + 1) * F.lit(all_s) / ((s + 1) * F.lit(all_t)))).cast("int")
    out = [0] * buckets
    for r in both.select("bucket", gain.alias("gain")).collect():
        out[r["bucket"]] = r["gain"]
    return out


def _noise(doc_id: Column, seed: int) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def scores(docs: DataFrame, target: DataFrame, buckets: int = 10_000, run: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row, stored."""
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be between 1 and {MAX_BUCKETS}")
    rows = stored(features(docs, buckets, run, text_col, F.col(id_col).alias("id")), "features")
    aim = features(target, buckets, run, text_col)
    gain = gains(stored(bucket_counts(rows), "corpus"), stored(bucket_counts(aim), "target"), buckets)
    listed = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<int>")  # folded into one constant
    total = F.aggregate("features", F.lit(0).cast("long"), lambda s, b: s + F.get(listed, b))
    n = F.size("features").cast("long")
    weighed = rows.select("id", n.alias("n_features"), "n_words", F.when(n > 0, F.floor(total / n)).otherwise(F.lit(0)).cast("long").alias("weight"))
    return stored(weighed.withColumn("score", F.col("weight") + _noise(F.col("id"), seed)), "scores")


def ranked_draw(scored: DataFrame, draw: int) -> DataFrame:
    """Adds ``rank`` to (id, .., score): 1, 2, .. for the ``draw`` highest scores, ties to the
    smaller id and null ids last; null for the rest.

    The histogram has a row a distinct score: scores are bounded integers (weights by the
    logarithm of counts, noise by 32 bits), so it has some hundred thousand rows at most,
    however many rows are scored.
    """
    none = F.lit(None).cast("long")
    steps = scored.groupBy("score").agg(F.count(F.lit(1)).alias("here"))
    steps = stored(steps.withColumn("before", F.sum("here").over(W.orderBy(F.desc("score"))) - F.col("here")).where(F.col("before") < draw), "histogram")
    cutoff = steps.agg(F.min("score")).first()[0]
    if cutoff is None:
        return scored.withColumn("rank", none)
    inside = F.row_number().over(W.partitionBy("score").orderBy(F.col("id").asc_nulls_last()))
    high = scored.where(F.col("score") >= cutoff).join(F.broadcast(steps.select("score", "before")), "score")
    high = high.withColumn("rank", F.col("before") + inside)
    high = high.select(*scored.columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return high.unionByName(scored.where(F.col("score") < cutoff).withColumn("rank", none))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    min_words: int = 20,
    buckets: int = 10_000,
    run: int = 1,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Scores every document by its likeness to ``target`` and draws ``percent`` of those with
    ``min_words`` words or more.

    Returns a row per input row: ``id_col``, n_features, weight, score, rank (1 for the
    highest score drawn, null for rows that are not drawn).  Null and empty texts have no
    features, weight 0, and are not drawn while ``min_words`` is positive.  Null ids share one
    pseudo-random number and rank after other ids of their score; repeated rows are rows of
    their own and get ranks of their own.  An empty target makes all words of the corpus equally
    unlikely there; an empty table gives an empty result.  Other columns are ignored.
    """
    rows = scores(docs, target, buckets, run, seed, id_col, text_col)
    fit = F.col("n_words") >= min_words
    drawn = ranked_draw(rows.where(fit), rows.where(fit).count() * percent // 100)
    every = drawn.unionByName(rows.where(~fit).withColumn("rank", F.lit(None).cast("long")))
    return every.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


SQL = (
    crc_sql("SELECT DISTINCT unnest(w) AS key FROM (SELECT w FROM d UNION ALL SELECT w FROM b)")
    .replace("WITH RECURSIVE", r"""WITH RECURSIVE
raw AS (SELECT row_number() OVER () AS id, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT id, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM raw),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),""")
    + """,
dw AS (SELECT id, crc % 10000 AS bucket FROM (SELECT id, unnest(w) AS key FROM d) JOIN crc USING (key)),
bw AS (SELECT crc % 10000 AS bucket FROM (SELECT unnest(w) AS key FROM b) JOIN crc USING (key)),
s AS (SELECT bucket, count(*) AS s FROM dw GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE))) AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT id, floor(sum(gain) / count(*))::BIGINT AS weight FROM dw JOIN g USING (bucket) GROUP BY id),
x AS (SELECT d.id, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM d LEFT JOIN m ON m.id = d.id),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * 10 // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (id)
"""
)
