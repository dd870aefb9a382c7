"""Hash-ranked selection: top-k, slices, interleaving, splits, shards, counterbalance, sequential allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.operators.durable import kept


def ranked(df: DataFrame, order: list, by: list | None = None, out: str = "rank", wide: bool = False) -> DataFrame:
    """Add a zero-based position, within `by` if given.

    Without groups, and with groups said to be `wide`, rows are numbered within
    the ranges of the first two characters of the first order column (a hash in
    hex) and shifted by the sizes of the ranges before, so no task holds more
    than a range of a group.  There are 256 ranges a group, so the table of sizes
    is joined as Spark sees fit.
    """
    if by and not wide:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    by = by or []
    first = order[0] if isinstance(order[0], Column) else F.col(order[0])
    own = df.withColumn("__lead", F.substring(first.cast("string"), 1, 2))
    sizes = own.groupBy(*by, "__lead").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__lead").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__lead").alias("__range"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    same = F.col("__lead").eqNullSafe(F.col("__range"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    own = own.withColumn("__at", F.row_number().over(Window.partitionBy(*by, "__lead").orderBy(*order)) - 1)
    met = own.join(before if by else F.broadcast(before), same)
    return met.withColumn(out, F.col("__at") + F.col("__before")).drop("__lead", "__range", "__at", "__before", *[f"__{c}" for c in by])


def with_digits(df: DataFrame, number: str, out: str) -> DataFrame:
    """df with an integer column as hex digits of one width that sort as the numbers do, spread over their range: an order for `ranked`."""
    ends = df.agg(F.min(number).alias("low"), F.max(number).alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    width = max(2, len(f"{high - low:x}"))
    return df.withColumn(out, F.lpad(F.lower(F.hex(F.col(number) - F.lit(low))), width, "0"))


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def interleaved(df: DataFrame, group: str, order: list, out: str = "turn") -> DataFrame:
    """Round robin over groups: position in the group first, then the group's name."""
    return ranked(df, order, [group], out, wide=True)


def splits(rank: Column, sizes: list[tuple[str, int]], rest: str | None = None) -> Column:
    """The named slice of consecutive ranks that a rank lies in."""
    out, upto = None, 0
    for name, n in sizes:
        upto += n
        out = F.when(rank < upto, F.lit(name)) if out is None else out.when(rank < upto, F.lit(name))
    return out.otherwise(F.lit(rest)) if rest is not None else out


def rotated(values: Column, by: Column) -> Column:
    """The array turned left by `by` places."""
    n = F.size(values)
    k = F.pmod(by, n)
    return F.concat(F.slice(values, k + 1, n - k), F.slice(values, F.lit(1), k))


def allocate(df: DataFrame, wants: list[tuple[str, Column, int]], item: str, order: list) -> DataFrame:
    """Families in turn take their first `n` compatible items that no family before took.

    wants lists (family, compatible, n), most restrictive first.  Each step is one
    top-n; taken ids are at most the sum of all n, so they are kept on the driver.
    """
    taken: list = []
    out = None
    for family, fits, n in wants:
        left = df.where(fits) if not taken else df.where(fits & ~F.col(item).isin(taken))
        rows = left.orderBy(*order).limit(n).select(F.lit(family).alias("family"), item).collect()
        taken += [r[item] for r in rows]
        mine = [(family, r[item], k) for k, r in enumerate(rows)]
        schema = f"family string, {item} {df.schema[item].dataType.simpleString()}, place int"
        part = df.sparkSession.createDataFrame(mine, schema)
        out = part if out is None else out.unionByName(part)
    return out


def greedy_cover(df: DataFrame, policy: str, item: str, k: int) -> DataFrame:
    """Up to k policies, each the one that covers most items not covered yet; ties go to the largest id.

    df: (policy, item) pairs that succeed.  One aggregate a step over what is left.
    """
    spark, picked, left = df.sparkSession, [], df.select(policy, item).distinct()
    for place in range(k):
        best = left.groupBy(policy).agg(F.count("*").alias("gain")).orderBy(F.desc("gain"), F.desc(policy)).limit(1).collect()
        if not best:
            break
        picked.append((place, best[0][policy], best[0]["gain"]))
        left = kept(left.join(left.where(F.col(policy) == best[0][policy]).select(item), item, "left_anti"))
    kind = df.schema[policy].dataType.simpleString()
    return spark.createDataFrame(picked, f"place int, {policy} {kind}, gain long")


def bitmap_cover(df: DataFrame, policy: str, item: str, k: int) -> DataFrame:
    """greedy_cover over bitmaps: (place, policy, gain).

    A policy's items (non-negative integers) become bits once, 32,768 a row; a step
    joins bits with the ones covered so far and counts, so it never touches items
    again.  Rows are as many as policies times the ranges of ids that they meet.
    """
    spark, n = df.sparkSession, F.col(item).cast("long")
    bits = df.where(n.isNotNull() & F.col(policy).isNotNull()).groupBy(policy, F.bitmap_bucket_number(n).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("own"))
    bits, picked = kept(bits, "bits"), []
    covered = bits.select("bucket", F.col("own").alias("seen")).limit(0)
    for place in range(k):
        open_ = bits.where(~F.col(policy).isin([p for _, p, _ in picked])) if picked else bits
        met = open_.join(covered, "bucket", "left")
        both = met.select(policy, "bucket", F.explode(F.array_compact(F.array("own", "seen"))).alias("b"), F.when(F.col("seen").isNotNull(), F.bitmap_count("seen")).otherwise(0).alias("before"))
        union = both.groupBy(policy, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("b")).alias("after"), F.max("before").alias("before"))
        best = union.groupBy(policy).agg(F.sum(F.col("after") - F.col("before")).alias("gain")).orderBy(F.desc("gain"), F.desc(policy)).limit(1).collect()
        if not best or not best[0]["gain"]:
            break
        picked.append((place, best[0][policy], best[0]["gain"]))
        new = bits.where(F.col(policy) == best[0][policy]).select("bucket", F.col("own").alias("seen"))
        covered = kept(covered.unionByName(new).groupBy("bucket").agg(F.bitmap_or_agg("seen").alias("seen")), "covered")
    kind = df.schema[policy].dataType.simpleString()
    return spark.createDataFrame(picked, f"place int, {policy} {kind}, gain long")
