"""Nearest neighbours on a sphere by a grid over the cubes that it passes through.

Places become points of the unit sphere, where the straight distance grows with the
great circle's: so poles and the date line are places like any other.  Cubes of a
side halved level by level hold the points; one within a cube's side of a place lies
in its cube or in one that touches it.  The search begins at the level whose fullest
cube holds few points and goes up: a place is settled as soon as its nearest one is
not farther than the side, and only the others go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.operators.durable import kept
from pairlens.operators.joins import EARTH_KM

#: Levels of cubes, and points that the fullest cube of the first level may hold.
LEVELS, FULL = 22, 32
#: Points up to which they are broadcast.
BROADCAST_ROWS = 100_000


def half_chord_squared(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Square of half the straight distance on the unit sphere; differences are taken in degrees, so mirrored places tie."""
    return F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)


def _cube(axis: Column, level: int | Column) -> Column:
    return F.floor((axis + 1) * F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level) / 2)


def _on_sphere(df: DataFrame, lat: str, lon: str) -> DataFrame:
    a, o = F.radians(lat), F.radians(lon)
    return df.withColumns({"__x": F.cos(a) * F.cos(o), "__y": F.cos(a) * F.sin(o), "__z": F.sin(a)})


def first_level(points: DataFrame, key: list[str], full: int = FULL) -> int:
    """The coarsest level none of whose cubes holds more than `full` points; one pass counts all levels."""
    levels = points.withColumn("__l", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    cubes = levels.groupBy(*key, "__l", *[_cube(F.col(c), F.col("__l")).alias(c) for c in ("__x", "__y", "__z")]).agg(F.count("*").alias("__n"))
    most = {r["__l"]: r["__n"] for r in cubes.groupBy("__l").agg(F.max("__n").alias("__n")).collect()}
    return next((k for k in range(LEVELS) if most.get(k, 0) <= full), LEVELS)


def nearest_place(left: DataFrame, right: DataFrame, by: list[str], lat: str, lon: str, rlat: str, rlon: str, pos: str, full: int = FULL) -> DataFrame:
    """Rows of left with the `pos` of the nearest row of right that has the same `by` columns, and `km`; the least pos wins ties.

    Rows without a place, and keys that right lacks, are left out.  Distances are
    compared as they are, unrounded.
    """
    # places that occur often are searched once
    places = left.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(*by, F.col(lat).cast("double").alias("__lat"), F.col(lon).cast("double").alias("__lon")).distinct()
    points = right.where(F.col(rlat).isNotNull() & F.col(rlon).isNotNull()).groupBy(*by, F.col(rlat).cast("double").alias("__rlat"), F.col(rlon).cast("double").alias("__rlon")).agg(F.min(pos).alias("__pos"))
    points = kept(_on_sphere(points, "__rlat", "__rlon"), "points")
    few = points.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    open_, cube = _on_sphere(places, "__lat", "__lon"), ["__i", "__j", "__k"]
    steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    settled: list[DataFrame] = []
    for level in range(first_level(points, by, full), -1, -1):
        own = open_
        for axis, name in zip(("__x", "__y", "__z"), cube, strict=True):
            own = own.withColumn("__d", F.explode(steps)).withColumn(name, _cube(F.col(axis), level) + F.col("__d"))
        cells = points.select(*by, "__rlat", "__rlon", "__pos", *[_cube(F.col(a), level).alias(n) for a, n in zip(("__x", "__y", "__z"), cube, strict=True)])
        met = own.join(F.broadcast(cells) if few else cells, [*by, *cube]).withColumn("__h", half_chord_squared(F.col("__lat"), F.col("__lon"), F.col("__rlat"), F.col("__rlon")))
        best = kept(met.groupBy(*by, "__lat", "__lon").agg(F.min(F.struct("__h", "__pos")).alias("__best")), "best")
        side = 2.0 ** (1 - level)
        near = best if level == 0 else best.where(2 * F.sqrt("__best.__h") <= side * (1 - 1e-9))
        settled.append(near)
        if level == 0:
            break
        open_ = kept(open_.join(near.select(*by, "__lat", "__lon"), [*by, "__lat", "__lon"], "left_anti"), "open")
        if open_.isEmpty():
            break
    found = settled[0]
    for part in settled[1:]:
        found = found.unionByName(part)
    found = found.select(*by, F.col("__lat"), F.col("__lon"), F.col("__best.__pos").alias(pos), (2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt("__best.__h")))).alias("km"))
    keyed = left.withColumns({"__lat": F.col(lat).cast("double"), "__lon": F.col(lon).cast("double")})
    return keyed.join(found, [*by, "__lat", "__lon"]).drop("__lat", "__lon")
