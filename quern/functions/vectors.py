"""Column functions over vectors (array<float> or array<double>), in double precision.

All are compositions of built-in functions, so they run in the JVM and can be pushed
around by the optimizer.  Vectors of unlike lengths compare as null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _doubles(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def rounded(x: Column, places: int = 6) -> Column:
    """Half away from zero; what is rounded to zero keeps its sign, as it does in SQL engines on
    IEEE numbers."""
    return F.when(x > 0, F.round(x, places)).when(x < 0, -F.round(-x, places)).otherwise(x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(total(F.transform(_doubles(v), lambda x: x * x)))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row: what a lambda function mentions of its
    surroundings is otherwise computed again for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _divided(v: Column, n: Column, otherwise: Column) -> Column:
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(otherwise)


def normalize(v: Column | str) -> Column:
    """v / |v|; a zero vector stays as it is."""
    return _once(_doubles(v), lambda x: _once(norm(x), lambda n: _divided(x, n, x)))


def squared_l2(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_l2(a, b))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of the angle between two vectors, null if one is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def angle(a: Column | str, b: Column | str) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b))))


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_doubles(a), _doubles(b), lambda x, y: x - y)


def weighted(a: Column | str, b: Column | str, wa: Column | float, wb: Column | float) -> Column:
    return F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * wa + y * wb)


def fuse_simple(image: Column | str, text: Column | str, w_image: float = 0.5, w_text: float = 0.5) -> Column:
    """normalize(w_image * image + w_text * text); negative weights count as 0, and two
    zero weights as equal ones."""
    wi, wt = max(0.0, w_image), max(0.0, w_text)
    if wi == 0 and wt == 0:
        wi = wt = 0.5
    return normalize(weighted(image, text, F.lit(wi), F.lit(wt)))


def fuse_directional(image: Column | str, text: Column | str, base: Column | str | None = None, alpha: float = 0.7) -> Column:
    """Moves an image along the direction from a base text to the text.

    Without a base, or where it equals the text, the direction is the text itself.
    """
    t = _doubles(text)
    b = t if base is None else F.coalesce(_doubles(base), t)
    direction = _once(minus(t, b), lambda step: _once(norm(step), lambda n: _divided(step, n, t)))
    return normalize(weighted(image, direction, F.lit(1.0), F.lit(float(alpha))))


def centroids(df: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """Mean vector of each group as ``centroid``; sums are combined before the shuffle."""
    each = df.select(*by, F.posexplode(_doubles(vector)).alias("_i", "_x"))
    mean = each.groupBy(*by, "_i").agg(F.avg("_x").alias("_x"))
    return mean.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("centroid"))


def crop_boxes(width: Column | str, height: Column | str) -> Column:
    """Squares (x, y, side) to embed, by aspect ratio: the centre below 1.3, two edge
    squares below 1.7, else both edges and the centre."""
    w, h = _col(width).cast("double"), _col(height).cast("double")
    side, long = F.least(w, h), F.greatest(w, h)
    ratio = long / side
    box = lambda at: F.struct(F.when(w >= h, at).otherwise(0.0).alias("x"), F.when(w >= h, F.lit(0.0)).otherwise(at).alias("y"), side.alias("side"))
    centre, start, end = box((long - side) / 2), box(F.lit(0.0)), box(long - side)
    return F.when(ratio < 1.3, F.array(centre)).when(ratio < 1.7, F.array(start, end)).otherwise(F.array(centre, start, end))


def average_crops(vectors: Column | str) -> Column:
    """Mean of an array of crop vectors, made a unit vector."""
    v = _col(vectors).cast("array<array<double>>")
    n = F.size(v)
    zero = F.transform(F.get(v, F.lit(0)), lambda x: F.lit(0.0))
    summed = F.aggregate(v, zero, lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return normalize(F.transform(summed, lambda x: x / n))


SQL_FUNCTIONS = {
    "vec_dot": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "l2_distance": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
    "l2_norm": "(v ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(transform(v, x -> x * x), 0D, (s, x) -> s + x))",
}


def register(spark: SparkSession) -> None:
    """Makes vec_dot, l2_distance and l2_norm callable from SQL, as inlined expressions."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


def register_knn(index: DataFrame, name: str = "knn", id_col: str = "vec_id", vector: str = "embedding") -> None:
    """Makes ``SELECT * FROM knn(query, k)`` callable from SQL: (vec_id, rank, dist) of the k rows
    of ``index`` nearest to an array of numbers, ties to the smaller id.

    The function is inlined as a plan over a view of the index; each task passes on k rows.  Rows
    without an id or vector are no neighbours.
    """
    spark = index.sparkSession
    register(spark)
    rows = index.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    rows.createOrReplaceTempView(f"{name}_index")
    near = f"SELECT vec_id, l2_distance(v, query) AS dist FROM {name}_index"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(query ARRAY<DOUBLE>, k INT) RETURNS TABLE (vec_id BIGINT, rank INT, dist DOUBLE) "
        f"RETURN SELECT vec_id, rank, dist FROM (SELECT vec_id, dist, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM ({near})) WHERE rank <= k"
    )
