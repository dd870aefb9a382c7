"""Pivots, eligibility and rates over factorial logs: one shuffle by item, then small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.nulls import is_value, rate, truthy
from pairlens.functions.stats import wilson


def pivot_conditions(df: DataFrame, keys: list[str], condition: str, values: list[str], fields: list[str]) -> DataFrame:
    """One row a key; column `<field>_<value>` has the field of that condition."""
    aggs = [F.max(F.when(F.col(condition) == v, F.col(f))).alias(f"{f}_{v}") for v in values for f in fields]
    return df.groupBy(*keys).agg(*aggs)


def rates(df: DataFrame, by: list[str], **hits: tuple[Column, Column]) -> DataFrame:
    """For each name=(among, hit): n, k, rate and Wilson interval of hit among rows where `among` holds."""
    aggs = []
    for name, (among, hit) in hits.items():
        aggs += [F.count_if(truthy(among)).alias(f"{name}_n"), F.count_if(truthy(among) & truthy(hit)).alias(f"{name}_k")]
    out = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    for name in hits:
        k, n = F.col(f"{name}_k"), F.col(f"{name}_n")
        low, high = wilson(k, n)
        out = out.withColumns({f"{name}_rate": rate(k, n), f"{name}_low": low, f"{name}_high": high})
    return out


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Doubles rounded half up, integers as long: the form in which results are compared."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        cols.append((F.round(c, places) if kind == "double" else c.cast("long") if kind == "int" else c).alias(f.name))
    return df.select(*cols)


def double_control(runs: DataFrame, by: list[str]) -> DataFrame:
    """Target rate on false records among items whose two controls are right, and the same among errors of reasoning."""
    wide = pivot_conditions(runs, list(dict.fromkeys(["model", "item_id", *by])), "condition", ["source_absent", "record_true", "record_false"], ["decide", "read_match", "knowledge"])
    eligible = is_value("decide_source_absent", "absent") & is_value("decide_record_true", "consistent")
    aware = eligible & truthy("read_match_record_false") & is_value("knowledge_record_false", "inconsistent")
    hit = is_value("decide_record_false", "consistent")
    return rates(wide, by, dc=(eligible, hit), eor=(aware, hit))


def common_to_all(df: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """Keys whose every row satisfies ok (null is no)."""
    return df.groupBy(*keys).agg(F.bool_and(truthy(ok)).alias("__all")).where("__all").drop("__all")
