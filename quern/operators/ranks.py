"""Places of rows in an order, without gathering the rows of a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.stages import stored

#: Counts of ranges are broadcast while they are measured to be this many rows or fewer.
FEW = 1 << 18


def positions(df: DataFrame, group: list[str], order: list[str], name: str = "pos", size: str | None = None) -> DataFrame:
    """Adds the place (from 0) of each row in its group, by ``order``; nulls come first.

    Rows are range partitioned by group and order and sorted there, so one group may span many
    tasks; a place is that in the range plus the counts of the ranges before.  Only the counts,
    a row a range and group, meet elsewhere.  ``size`` names a column for the rows of the group.
    Rows alike in all these columns get places in any order.
    """
    keys = [*group, *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(rows, "places").withColumn("_range", F.shiftright("_at", 33))
    runs = rows.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # without a group there is one row a range, so one task may hold them
    upto = F.sum("_n").over(W.partitionBy(*group).orderBy("_range")) - F.col("_n")
    runs = runs.withColumns({"_before": upto, "_all": F.sum("_n").over(W.partitionBy(*group))})
    runs = stored(runs.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_first", "_before", "_all"), "ranges")
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    found = rows.join(F.broadcast(runs) if runs.count() <= FEW else runs, same)
    found = found.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before"))
    if size:
        found = found.withColumn(size, F.col("_all"))
    return found.select(*df.columns, name, *([size] if size else []))


def quantiles(df: DataFrame, column: str, wanted: dict[str, float]) -> DataFrame:
    """One row with exact quantiles, interpolated between the two nearest values; null where
    there is no value.  Values are placed by ranges, and no task holds all of them."""
    values = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    placed = positions(values, [], ["x"], "at", "n")
    found = []
    for name, q in wanted.items():
        place = (F.col("n") - 1) * q
        low, high = F.floor(place), F.ceil(place)
        at = lambda edge: F.max(F.when(F.col("at") == edge, F.col("x")))
        found += [at(low).alias(f"{name}_low"), at(high).alias(f"{name}_high"), F.max(place - low).alias(f"{name}_part")]
    between = lambda name: F.when(F.col(f"{name}_part") == 0, F.col(f"{name}_low")).otherwise((1 - F.col(f"{name}_part")) * F.col(f"{name}_low") + F.col(f"{name}_part") * F.col(f"{name}_high"))
    return placed.agg(*found).select(*[between(name).alias(name) for name in wanted])
