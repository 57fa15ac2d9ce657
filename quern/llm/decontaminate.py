"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a window of tokens: tokens under a 1 are hashed, tokens under
a 0 are ignored, so a window still hits after a substitution at an ignored position.
Every position of every document is hashed under each mask and joined with the hashes of
the benchmark items.  Around each hit the item is laid over the document on the hit's
diagonal, and the pair is kept where enough tokens of one window agree.  So a long passage of
an item is found whether or not the rest of the item is there, and an insertion or deletion
costs no more than the window it falls in.

All of it is DataFrame code: texts are cut into overlapping pieces, their positions are
exploded and hashed in generated code, and only hits (a document position that shares a seed
with an item) go further.  Seeds of the benchmark are broadcast while their measured size
allows it; otherwise the join shuffles positions and seeds, and pieces are joined to the hits
alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_BYTES, stored, unused

#: Masks of one span; each ignores other positions.  Whichever two of 13 tokens in a row differ,
#: one of the masks gives a hit among the rest.
MASKS = ("1000111111", "1001110111", "1101101101", "1111010011")
SPAN = 10
#: Tokens of the window that has to agree, and the share of it that may not be less.
WINDOW, MIN_SHARE = 13, 0.8
#: Items shorter than SPAN, but not than this, are looked for word by word.
SHORT = 5
#: Fewest tokens in the core of a piece of text; work on one row is bounded by pieces, not texts.
CORE = 256


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def _seed(words: Column, at: Column, mask: str, number: int) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(words, at + j) for j, bit in enumerate(mask) if bit == "1"])


def _seeds(words: Column, at: Column) -> Column:
    return F.array(*[F.struct(_seed(words, at, m, k).alias("seed"), F.lit(k).alias("k")) for k, m in enumerate(MASKS)])


def _positions(words: Column) -> Column:
    last = F.size(words) - SPAN
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _pieces(words: Column, reach: int) -> Column:
    """Cuts an array of tokens into pieces of bounded length, each token in the core of one.

    A piece has ``reach`` tokens of its neighbours on either side, so that an item laid over a
    hit in the core lies within the piece.  ``first`` is the token that the piece begins with and
    ``skip`` the number of tokens before its core.
    """
    core = max(CORE, 2 * reach)

    def piece(s: Column) -> Column:
        first = F.greatest(s - reach, F.lit(0))
        return F.struct(first.alias("first"), (s - first).alias("skip"), F.lit(core).alias("core"), F.slice(words, first + 1, s - first + core + reach).alias("words"))

    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(core)), piece)


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_share: float = MIN_SHARE,
    window: int = WINDOW,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Overlaps between documents and benchmark items.

    Returns, for each document and item that overlap, the best place: ``id_col``,
    ``item_col``, ``start`` (token of the document under the item's first token; below 0
    if the document begins inside the item), ``n_equal`` and ``n_item`` (tokens that
    agree, tokens of the item), ``n_window`` (tokens that agree in the best window),
    ``share`` (n_equal / n_item).  A pair counts if, on one diagonal with a hit,
    ``min_share`` of some ``window`` consecutive tokens of the item agree; an item of fewer
    tokens is one window.  Items of SHORT to SPAN - 1 tokens count where all of them stand in a
    row; items of fewer tokens, which are no evidence, match nothing.

    Null or empty texts match nothing.  Rows with a null id are ignored, as no result could
    name them.  Repeated rows and repeated passages give one row a pair; of equally good
    places the first is given.  Items repeated under several ids each match.  Other columns
    are ignored; an empty table on either side gives an empty result.
    """
    items = benchmark.select(F.col(item_col).alias("item"), tokens(F.col(item_text_col)).alias("item_words")).where("item is not null").dropDuplicates()
    items = stored(items.where(F.size("item_words") >= SHORT), "items")
    seeds = items.select("item", "item_words", F.explode(_positions(F.col("item_words"))).alias("item_at"))
    seeds = seeds.select("item", "item_at", F.explode(_seeds(F.col("item_words"), F.col("item_at"))).alias("s")).select("item", "item_at", "s.seed", "s.k")
    brief = items.where(F.size("item_words") < SPAN).select("item", F.lit(0).alias("item_at"), F.xxhash64("item_words").alias("seed"), F.lit(len(MASKS)).alias("k"))
    lengths = sorted(r[0] for r in items.where(F.size("item_words") < SPAN).select(F.size("item_words")).distinct().collect())
    seeds = stored(seeds.unionByName(brief).groupBy("seed").agg(F.collect_set(F.struct("item", "item_at", "k")).alias("places")), "seeds")
    size = seeds.agg(F.sum(F.size("places") * 24 + 16)).first()[0] or 0
    words_size, longest = items.agg(F.sum(F.size("item_words") * 24), F.max(F.size("item_words"))).first()
    small = max(size, words_size or 0) <= broadcast_bytes
    keep = F.broadcast if small else (lambda df: df)

    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("text_words")).where("id is not null")
    words = words.select("id", F.explode(_pieces(F.col("text_words"), max(SPAN, longest or 0))).alias("p"))
    words = words.select("id", "p.first", "p.skip", "p.core", "p.words").withColumn("row", F.monotonically_increasing_id())
    if not small:
        words = stored(words, "words")
    # Positions count from the start of the piece; only those of its core are looked up.
    last = F.least(F.col("skip") + F.col("core") - 1, F.size("words") - min([SPAN, *lengths]))
    spots = F.when(last >= F.col("skip"), F.sequence(F.col("skip"), last)).otherwise(F.array().cast("array<int>"))
    at = words.select("row", "id", "first", "words", F.explode(spots).alias("at"))
    room = F.size("words") - F.col("at")
    masked = [F.when(room >= SPAN, _seed(F.col("words"), F.col("at"), m, k)) for k, m in enumerate(MASKS)]
    exact = [F.when(room >= n, F.xxhash64(F.slice("words", F.col("at") + 1, n))) for n in lengths]
    hits = at.select("row", "id", "first", "words", "at", F.explode(F.array(*masked, *exact)).alias("seed")).where("seed is not null")
    if small:
        hits = hits.join(F.broadcast(seeds), "seed")
    else:
        hits = hits.select("row", "at", "seed").join(seeds, "seed").select("row", "at", "places").join(words, "row")
    laid = hits.select("id", "first", "words", "at", F.explode("places").alias("place"))
    laid = laid.select("id", "first", "words", "at", "place.item", "place.item_at", "place.k", (F.col("at") - F.col("place.item_at")).alias("start"))
    laid = laid.join(keep(items), "item")
    # Of hits in a row under one mask the first is enough: they lie on the same diagonal.
    before = lambda c, at: F.coalesce(*[F.when(F.col("k") == k, _seed(F.col(c), F.col(at) - 1, m, k)) for k, m in enumerate(MASKS)])
    follows = (F.col("at") > 0) & (F.col("item_at") > 0) & (F.col("k") < len(MASKS)) & (before("words", "at") == before("item_words", "item_at"))
    laid = laid.where(~F.coalesce(follows, F.lit(False)))
    n_item = F.size("item_words")
    # Only the tokens under the item go on.
    part = F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, n_item).alias("part")
    laid = laid.select("id", "item", (F.col("first") + F.col("start")).alias("start"), "item_words", part)
    place = lambda j: j + F.least(F.col("start"), F.lit(0))
    under = lambda j: (place(j) >= 0) & (place(j) < F.size("part")) & (F.get(F.col("part"), F.greatest(place(j), F.lit(0))) == F.get(F.col("item_words"), j))
    equal = F.transform(F.sequence(F.lit(0), n_item - 1), lambda j: F.when(under(j), 1).otherwise(0))
    # Through explode, as the condition on windows would otherwise be moved into the join, with
    # ``equal`` written out, and so computed anew, in every window.
    laid = laid.select("id", "item", "start", n_item.alias("n_item"), F.explode(F.array(equal)).alias("equal"))
    add = lambda a, x: a + x
    wide = F.least(F.lit(window), F.col("n_item"))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.col("n_item") - wide), lambda s: F.aggregate(F.slice("equal", s + 1, wide), F.lit(0), add)))
    laid = laid.select("id", "item", "start", "n_item", F.aggregate("equal", F.lit(0), add).alias("n_equal"), best.alias("n_window"))
    needed = F.when(F.col("n_item") < SPAN, F.col("n_item")).otherwise(F.ceil(min_share * F.least(F.lit(window), F.col("n_item")) - 1e-9))
    laid = laid.where(F.col("n_window") >= needed)
    best = laid.groupBy("id", "item").agg(F.max(F.struct("n_equal", (-F.col("start")).alias("before"), "n_window", "n_item")).alias("b"))
    return best.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        (-F.col("b.before")).cast("long").alias("start"),
        F.col("b.n_equal").cast("long").alias("n_equal"),
        F.col("b.n_item").cast("long").alias("n_item"),
        F.col("b.n_window").cast("long").alias("n_window"),
        (F.col("b.n_equal") / F.col("b.n_item")).alias("share"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents, all columns as they are, without those that overlap a benchmark item.

    Rows with a null id stay, as nothing could name them, and so do null and empty texts.
    Repeated rows go together.  An empty table of documents or items drops nothing.  The ids
    to drop are broadcast while measured to be few; otherwise the join shuffles.
    """
    name = unused(docs, "leak")
    found = stored(matches(docs, benchmark, id_col=id_col, **options).select(F.col(id_col).alias(name)).distinct(), "leaks")
    if found.count() * 16 <= BROADCAST_BYTES:
        found = F.broadcast(found)
    return docs.join(found, F.col(id_col) == F.col(name), "left_anti")


#: Plain SQL with the same result: every document is laid against every benchmark window
#: by equality of the masked tokens.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS v FROM benchmark WHERE item_id IS NOT NULL),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM d WHERE len(w) >= 10),
bp AS (SELECT item_id, v, unnest(range(1, len(v) - 8)) AS j FROM b WHERE len(v) >= 10),
ds AS (
  SELECT doc_id, i, 0 AS k, concat_ws(' ', w[i], w[i+4], w[i+5], w[i+6], w[i+7], w[i+8], w[i+9]) AS s FROM dp
  UNION ALL SELECT doc_id, i, 1, concat_ws(' ', w[i], w[i+3], w[i+4], w[i+5], w[i+7], w[i+8], w[i+9]) FROM dp
  UNION ALL SELECT doc_id, i, 2, concat_ws(' ', w[i], w[i+1], w[i+3], w[i+4], w[i+6], w[i+7], w[i+9]) FROM dp
  UNION ALL SELECT doc_id, i, 3, concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3], w[i+5], w[i+8], w[i+9]) FROM dp),
bs AS (
  SELECT item_id, j, 0 AS k, concat_ws(' ', v[j], v[j+4], v[j+5], v[j+6], v[j+7], v[j+8], v[j+9]) AS s FROM bp
  UNION ALL SELECT item_id, j, 1, concat_ws(' ', v[j], v[j+3], v[j+4], v[j+5], v[j+7], v[j+8], v[j+9]) FROM bp
  UNION ALL SELECT item_id, j, 2, concat_ws(' ', v[j], v[j+1], v[j+3], v[j+4], v[j+6], v[j+7], v[j+9]) FROM bp
  UNION ALL SELECT item_id, j, 3, concat_ws(' ', v[j], v[j+1], v[j+2], v[j+3], v[j+5], v[j+8], v[j+9]) FROM bp),
n AS (SELECT item_id, len(v) AS n, array_to_string(v, ' ') AS s FROM b WHERE len(v) BETWEEN 5 AND 9),
q AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM n) WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, item_id, i - j AS start FROM ds JOIN bs USING (k, s)
      UNION SELECT doc_id, item_id, i - 1 FROM q JOIN n USING (n, s)),
e AS (SELECT doc_id, item_id, start, len(v) AS n_item,
             list_transform(range(1, len(v) + 1), lambda x: CASE WHEN start + x >= 1 AND w[greatest(start + x, 1)] = v[x] THEN 1 ELSE 0 END) AS e
      FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
f AS (SELECT doc_id, item_id, start, n_item, list_sum(e) AS n_equal,
             list_max(list_transform(range(1, n_item - least(13, n_item) + 2), lambda x: list_sum(e[x : x + least(13, n_item) - 1]))) AS n_window
      FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, start) AS rank
      FROM f WHERE n_window >= CASE WHEN n_item < 10 THEN n_item ELSE ceil(0.8 * least(13, n_item) - 1e-9) END)
SELECT doc_id, item_id, start::BIGINT AS start, n_equal::BIGINT AS n_equal, n_item::BIGINT AS n_item, n_window::BIGINT AS n_window, n_equal / n_item AS share
FROM r WHERE rank = 1
"""
