"""Joins beyond equality: nearest in time with tolerance, last value before, ids in every source, first accepted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def nearest_in_time(left: DataFrame, right: DataFrame, by: list[str], tick: str, other: str, tolerance: int, ties: list[str]) -> DataFrame:
    """For each row of left the row of right with the same keys whose tick is nearest, `tolerance` away at most.

    Of two at the same distance the earlier wins, then the given columns decide.
    Ticks are cut into stretches of the tolerance, so a row meets only its own
    stretch and its two neighbours: an equality join, never a range over all.
    """
    width = tolerance + 1
    l = left.withColumn("__id", F.monotonically_increasing_id()) if "__id" not in left.columns else left
    near = l.withColumn("__cell", F.explode(F.array(*[F.floor(F.col(tick) / width) + d for d in (-1, 0, 1)])))
    r = right.withColumn("__cell", F.floor(F.col(other) / width))
    met = near.join(r, [*by, "__cell"]).where(F.abs(F.col(other) - F.col(tick)) <= tolerance)
    w = Window.partitionBy("__id").orderBy(F.abs(F.col(other) - F.col(tick)), F.col(other), *ties)
    return met.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__cell", "__id")


def latest_before(left: DataFrame, right: DataFrame, by: list[str], tick: str, other: str, field: str) -> DataFrame:
    """left with the last value of `field` in right at or before its tick: one union and one running window, no join."""
    l = left.select("*", F.col(tick).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[field].dataType).alias("__v"))
    r = right.select(*[F.col(k) for k in by], F.col(other).alias("__t"), F.lit(0).alias("__side"), F.col(field).alias("__v"))
    w = Window.partitionBy(*by).orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True)
    return both.withColumn(f"last_{field}", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__t", "__side", "__v")


def in_every(df: DataFrame, id_: str, source: str, k: int) -> DataFrame:
    """Ids that occur in k sources."""
    return df.groupBy(id_).agg(F.count_distinct(source).alias("__k")).where(F.col("__k") == k).select(id_)


def first_accepted(df: DataFrame, accept: Column, key: list[str], order: list) -> DataFrame:
    """Of the rows that pass every filter, the first for each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.where(accept).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
