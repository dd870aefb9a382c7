"""Integrity audits: every function returns violations as rows, none when all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _row(rule: str, key: list[str], detail: Column) -> list[Column]:
    return [F.lit(rule).alias("rule"), F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key]).alias("key"), detail.cast("string").alias("detail")]


def coverage(expected: DataFrame, observed: DataFrame, key: list[str]) -> DataFrame:
    """Duplicate, missing and extra keys of observed against expected."""
    e = expected.groupBy(*key).agg(F.count("*").alias("__e"))
    o = observed.groupBy(*key).agg(F.count("*").alias("__o"))
    both = e.join(o, key, "full_outer").withColumns({"__e": F.coalesce("__e", F.lit(0)), "__o": F.coalesce("__o", F.lit(0))})
    rules = F.array_compact(F.array(
        F.when(F.col("__o") > 1, F.lit("duplicate")), F.when(F.col("__e") > 1, F.lit("duplicate_expected")),
        F.when(F.col("__o") == 0, F.lit("missing")), F.when(F.col("__e") == 0, F.lit("extra")),
    ))
    return both.withColumn("rule", F.explode(rules)).select("rule", *_row("", key, F.col("__o"))[1:])


def drift(left: DataFrame, right: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Fields that differ (null-safe) between rows of the same key."""
    r = right.select(*key, *[F.col(f).alias(f"__{f}") for f in fields])
    j = left.join(r, key)
    changed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), F.lit(f)) for f in fields]))
    return j.withColumn("field", F.explode(changed)).select(*_row("drift", key, F.col("field")))


def factorial(df: DataFrame, item: list[str], condition: str, values: list[str]) -> DataFrame:
    """Items that do not have exactly the given conditions, once each."""
    want = F.array(*[F.lit(v) for v in sorted(values)])
    per = df.groupBy(*item).agg(F.array_sort(F.collect_set(condition)).alias("have"), F.count("*").alias("n"))
    return per.where((F.col("have") != want) | (F.col("n") != len(values))).select(*_row("conditions", item, F.array_join("have", ",")))


def invariance(df: DataFrame, item: list[str], fields: list[str]) -> DataFrame:
    """Fields with several values (null counts as one) within an item."""
    per = df.groupBy(*item).agg(*[(F.count_distinct(F.col(f)) + F.max(F.col(f).isNull().cast("int"))).alias(f) for f in fields])
    bad = F.array_compact(F.array(*[F.when(F.col(f) > 1, F.lit(f)) for f in fields]))
    return per.withColumn("field", F.explode(bad)).select(*_row("varies", item, F.col("field")))


def repeated(df: DataFrame, signature: list[str]) -> DataFrame:
    """Signatures that more than one row has."""
    return df.groupBy(*signature).agg(F.count("*").alias("n")).where("n > 1").select(*_row("repeated", signature, F.col("n")))


def balance(df: DataFrame, cell: list[str], tolerance: int = 0) -> DataFrame:
    """One row if the largest and the smallest cell differ by more than tolerance."""
    per = df.groupBy(*cell).agg(F.count("*").alias("n"))
    return per.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).where(F.col("hi") - F.col("lo") > tolerance).select(F.lit("balance").alias("rule"), F.lit(",".join(cell)).alias("key"), F.concat_ws("..", "lo", "hi").alias("detail"))


def one_difference(left: Column, right: Column) -> Column:
    """True when two arrays have equal length and differ in exactly one place."""
    unequal = F.aggregate(F.zip_with(left, right, lambda a, b: F.when(a.eqNullSafe(b), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    return (F.size(left) == F.size(right)) & (unequal == 1)


def overlap(df: DataFrame, dataset: str, content: str) -> DataFrame:
    """Contents shared by two datasets, counted for each unordered pair."""
    d = df.select(dataset, content).distinct()
    sets = d.groupBy(content).agg(F.array_sort(F.collect_set(dataset)).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))


def journal(calls: DataFrame, call: str, kind: str, at: str, fields: list[str]) -> DataFrame:
    """Calls without exactly one start and one finish, with changed fields, or finished before they started."""
    start, finish = F.col(kind) == "call_started", F.col(kind) == "call_finished"
    aggs = [F.count_if(start).alias("s"), F.count_if(finish).alias("f"), F.min(F.when(start, F.col(at))).alias("t0"), F.max(F.when(finish, F.col(at))).alias("t1")]
    for x in fields:
        aggs += [F.max(F.when(start, F.col(x))).alias(f"s_{x}"), F.max(F.when(finish, F.col(x))).alias(f"f_{x}")]
    per = calls.groupBy(call).agg(*aggs)
    both = (F.col("s") == 1) & (F.col("f") == 1)
    rules = [F.when(F.col("s") != 1, F.lit("starts")), F.when(F.col("f") != 1, F.lit("finishes")), F.when(both & (F.col("t1") < F.col("t0")), F.lit("time"))]
    rules += [F.when(both & ~F.col(f"s_{x}").eqNullSafe(F.col(f"f_{x}")), F.lit(f"field {x}")) for x in fields]
    return per.withColumn("rule", F.explode(F.array_compact(F.array(*rules)))).select("rule", F.col(call).cast("string").alias("key"), F.concat_ws("/", "s", "f").alias("detail"))


def adjacency(df: DataFrame, item: list[str], index: str, kind: str, candidate: str, success: str, budget: int) -> DataFrame:
    """Calls of an item in the order of their indices, as violations; rows of one index stand by kind and candidate.

    Indices must be 1..n: a row whose place is not its index says `index`, and every
    row of a repeated one `duplicate`.  A read must stand right behind a decision on
    the same candidate, a success must have the last index, and no place may exceed
    the budget.
    """
    w = Window.partitionBy(*item).orderBy(index, kind, candidate)
    same, full = Window.partitionBy(*item, index), Window.partitionBy(*item)
    c = df.select(
        *item, index, kind, success, F.row_number().over(w).alias("place"), F.lag(F.struct(kind, candidate)).over(w).alias("before"), F.struct(F.lit("decision").alias(kind), candidate).alias("own"),
        F.count("*").over(same).alias("copies"), F.max(index).over(full).alias("last"),
    )
    rules = F.array_compact(F.array(
        F.when(~F.col("place").eqNullSafe(F.col(index)), F.lit("index")), F.when(F.col("copies") > 1, F.lit("duplicate")), F.when((F.col(kind) == "read") & ~F.col("before").eqNullSafe(F.col("own")), F.lit("read_order")),
        F.when(F.coalesce(F.col(success), F.lit(False)) & ~F.col(index).eqNullSafe(F.col("last")), F.lit("after_success")), F.when(F.col("place") > budget, F.lit("budget")),
    ))
    return c.withColumn("rule", F.explode(rules)).select("rule", *_row("", [*item, index], F.col(kind))[1:])


def domains(df: DataFrame, key: list[str], checks: dict[str, Column]) -> DataFrame:
    """Rows with the first check (in order) that does not hold; null does not hold."""
    reason = None
    for name, ok in checks.items():
        bad = ~F.coalesce(ok, F.lit(False))
        reason = F.when(bad, F.lit(name)) if reason is None else reason.when(bad, F.lit(name))
    return df.withColumn("__reason", reason).where("__reason is not null").select(*_row("domain", key, F.col("__reason")))


def severity(df: DataFrame, key: list[str], truth: str, values: list[str], near: float = 0.05) -> DataFrame:
    """Rows of which a value is (nearly) the truth, or whose distances to it do not grow from value to value; a null distance is out of order."""
    away = [F.abs(F.col(v) - F.col(truth)) for v in values]
    close = [d <= F.greatest(1e-9 * F.greatest(F.abs(F.col(v)), F.abs(F.col(truth))), F.lit(near)) for d, v in zip(away, values, strict=True)]
    equal = F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in zip(close, values, strict=True)]))
    grows = F.lit(True)
    for a, b in zip(away, away[1:], strict=False):
        grows = grows & F.coalesce(a < b, F.lit(False))
    rule = F.when(F.size(equal) > 0, "equal").when(~grows, "order")
    return df.withColumns({"__equal": equal, "__rule": rule}).where("__rule is not null").select(F.col("__rule").alias("rule"), *_row("", key, F.array_join("__equal", "|"))[1:])


def product_balance(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cells of the full product of the values of a and b that are empty or unlike the most common count."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    grid = df.select(a).distinct().join(F.broadcast(df.select(b).distinct()), F.lit(True))
    cells = grid.join(n, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    most = cells.agg(F.max("n").alias("top"))
    return cells.join(F.broadcast(most), F.lit(True)).where(F.col("n") != F.col("top")).select(*_row("cell", [a, b], F.col("n")))
