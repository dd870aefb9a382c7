"""Summaries of logs: budgets, terminal rows, distributions, extremes, policies, attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(value: str) -> list[Column]:
    """count, minimum, maximum and mean of a column; its exact median comes from `quantiles`, which gathers no group."""
    return [F.count(value).alias("count"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.avg(value).alias("mean")]


def success_budgets(df: DataFrame, by: list[str], item: str, rank: str, success: Column, budgets: list[int]) -> DataFrame:
    """Items, successes within k, and mean queries charged (k where none succeeds), for each budget k."""
    first = df.groupBy(*by, item).agg(F.min(F.when(success, F.col(rank))).alias("first"))
    each = first.withColumn("budget", F.explode(F.array(*[F.lit(k) for k in budgets])))
    return each.groupBy(*by, "budget").agg(
        F.count("*").alias("items"), F.count_if(F.col("first") <= F.col("budget")).alias("successes"),
        F.avg(F.least(F.coalesce("first", "budget"), "budget")).alias("mean_queries"),
    )


def terminal_rows(events: DataFrame, item: str, round_: str, success: Column, feedback: str, limit: int) -> DataFrame:
    """One row an item: first success, outcome, queries used and the feedback in order."""
    per = events.groupBy(item).agg(
        F.min(F.when(success, F.col(round_))).alias("first_success"), F.max(round_).alias("queries"),
        F.transform(F.array_sort(F.collect_list(F.struct(round_, feedback))), lambda x: x[feedback]).alias("feedback"),
    )
    outcome = F.when(F.col("first_success").isNotNull(), "success").when(F.col("queries") >= limit, "budget_exhausted").otherwise("stopped")
    return per.withColumn("outcome", outcome)


def largest(df: DataFrame, by: list[str], value: str, order: str, field: str) -> DataFrame:
    """field of the row with the largest value in each group; the first in order wins ties."""
    return df.groupBy(*by).agg(F.max_by(field, F.struct(F.col(value), -F.col(order))).alias(field), F.max(value).alias(value))


def latest_complete(df: DataFrame, item: str, attempt: str, complete: Column) -> DataFrame:
    """The newest complete attempt of each item."""
    w = Window.partitionBy(item).orderBy(F.desc(attempt))
    return df.where(complete).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def exemplars(df: DataFrame, item: str, criteria: list[list]) -> DataFrame:
    """For each list of orderings in turn the first item not chosen yet."""
    taken, spark = [], df.sparkSession
    for k, order in enumerate(criteria):
        left = df if not taken else df.where(~F.col(item).isin([t[1] for t in taken]))
        row = left.orderBy(*order).select(item).limit(1).collect()
        if row:
            taken.append((k, row[0][item]))
    return spark.createDataFrame(taken, f"criterion int, {item} {df.schema[item].dataType.simpleString()}")


def factor_means(df: DataFrame, policy: str, factors: list[str], item: str, value: str) -> DataFrame:
    """Mean over items of the per-item mean over the policies of each factor level; policy ids are joined by dashes."""
    part = F.split(F.col(policy), "-")
    levels = F.array(*[F.struct(F.lit(f).alias("factor"), F.element_at(part, k + 1).alias("level")) for k, f in enumerate(factors)])
    long = df.withColumn("x", F.explode(levels)).select("x.factor", "x.level", item, value)
    return long.groupBy("factor", "level", item).agg(F.avg(value).alias("m")).groupBy("factor", "level").agg(F.count("*").alias("items"), F.avg("m").alias("mean"))
