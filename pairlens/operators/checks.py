"""Lookups that must not miss, filters with wildcards, exact slices, expected calls, signatures."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.operators.durable import kept

#: Suffixes that a row tries until it must have a signature of its own.
ATTEMPTS = 100


def lookup(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows with the columns of `known` (a row a key); a key that is not known fails the query."""
    met = rows.join(known.withColumn("__known", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    # the check is part of a kept column, so that it cannot be pruned
    first = known.columns[1] if known.columns[0] == key else known.columns[0]
    return met.withColumn(first, F.when(F.col("__known"), F.col(first)).otherwise(missing.cast(known.schema[first].dataType))).drop("__known")


def wanted(**lists: list[str]) -> Column:
    """Rows whose columns have a listed value each; a list with an asterisk takes every value."""
    parts = [F.col(c).isin(*values) for c, values in lists.items() if "*" not in values]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def with_truth(df: DataFrame, columns: list[str], **literals: str) -> DataFrame:
    """The columns, and the literals as columns."""
    return df.select(*columns, *[F.lit(v).alias(k) for k, v in literals.items()])


def place_in(order: list[str], c: str) -> Column:
    """Place of a value in a list of names, from 0; null for others."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(c))
    return F.when(at > 0, at - 1)


def exact_slice(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit in order; fewer fail."""
    part = df.orderBy(*order).offset(offset).limit(limit)
    if (got := part.count()) != limit:
        raise ValueError(f"{got} rows from {offset} on, {limit} were asked for")
    return part


def expected_calls(items: DataFrame, key: str, conditions: list[str], strategies: list[str], probes: list[str]) -> DataFrame:
    """(key, condition, strategy): each item under all conditions and strategies, and its probes, which have no strategy."""
    grid = F.flatten(F.array(*[F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(s).alias("strategy")) for s in strategies]) for c in conditions]))
    alone = F.array(*[F.struct(F.lit(p).alias("condition"), F.lit("").alias("strategy")) for p in probes])
    return items.select(key, F.explode(F.concat(grid, alone)).alias("__x")).select(key, "__x.*")


def call_differences(expected: DataFrame, observed: DataFrame, key: list[str]) -> DataFrame:
    """Keys of one side only, and keys observed more than once: key columns and what is wrong."""
    e, o = expected.select(*key).distinct().withColumn("__e", F.lit(1)), observed.groupBy(*key).agg(F.count("*").alias("__n"))
    same = reduce(lambda a, c: a & F.col(f"e.{c}").eqNullSafe(F.col(f"o.{c}")), key, F.lit(True))
    both = e.alias("e").join(o.alias("o"), same, "full")
    wrong = F.when(F.col("__n").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(F.col("__n") > 1, "repeated")
    return both.select(*[F.coalesce(F.col(f"e.{c}"), F.col(f"o.{c}")).alias(c) for c in key], wrong.alias("wrong")).where("wrong is not null")


def unused(items: DataFrame, key: str, prior: DataFrame, fields: list[str]) -> DataFrame:
    """Items whose key stands in none of the listed id columns of a prior split; its other columns do not count."""
    taken = reduce(lambda a, b: a.union(b), [prior.select(F.col(f).alias(key)) for f in fields]).where(F.col(key).isNotNull()).distinct()
    return items.join(taken, key, "left_anti")


def spread(df: DataFrame, item: list[str], value: str, most: int) -> DataFrame:
    """Items whose values differ by more than `most`: item, low, high."""
    return df.groupBy(*item).agg(F.min(value).alias("low"), F.max(value).alias("high")).where(F.col("high") - F.col("low") > most)


def unique_signatures(df: DataFrame, item: str, signature, attempts: int = ATTEMPTS) -> DataFrame:
    """(item, attempt, signature): rows in order of item take their first signature that no row before has.

    signature(attempt column) gives a row's signature at an attempt.  Every row
    asks for one signature; the first in order holds it and the others go on to
    their next.  As all signatures prefer the same order, this ends in what taking
    rows one by one gives.  A row without one after `attempts` fails the query.
    """
    state = kept(df.withColumn("attempt", F.lit(0)))
    while True:
        asked = state.withColumn("signature", signature(F.col("attempt")))
        best = asked.groupBy("signature").agg(F.min(item).alias("__best"))
        held = kept(asked.join(best, "signature"))
        if not held.where(F.col(item) != F.col("__best")).limit(1).count():
            return held.select(item, "attempt", "signature")
        state = held.withColumn("attempt", F.col("attempt") + (F.col(item) != F.col("__best")).cast("int")).drop("signature", "__best")
        if state.where(F.col("attempt") >= attempts).limit(1).count():
            raise ValueError(f"a row has no signature of its own after {attempts} attempts")


def run_spec(spec: Column) -> Column:
    """struct<label, model, dataset, method, paths> of a spec LABEL=PATH, MODEL@DATASET=PATH or DATASET/METHOD/MODEL=PATH,PATH; another text fails the query."""
    label, paths = F.regexp_extract(spec, r"(?s)\A([^=]+)=(.+)\z", 1), F.regexp_extract(spec, r"(?s)\A([^=]+)=(.+)\z", 2)
    three, two = F.split(label, "/"), F.split(label, "@")
    is_three, is_two = F.size(three) == 3, F.size(two) == 2
    pick = lambda a, b: F.when(is_three, F.get(three, F.lit(a))).when(is_two, F.get(two, F.lit(b)) if b is not None else None)
    known = F.struct(label.alias("label"), pick(2, 0).alias("model"), pick(0, 1).alias("dataset"), pick(1, None).alias("method"), F.filter(F.split(paths, ","), lambda p: p != "").alias("paths"))
    return F.when(label != "", known).otherwise(F.raise_error(F.concat(F.lit("not a spec: "), F.coalesce(spec, F.lit("null")))).cast("struct<label:string,model:string,dataset:string,method:string,paths:array<string>>"))


def run_specs(spark: SparkSession, specs: list[str]) -> DataFrame:
    """(label, model, dataset, method, paths) of a list of specs."""
    for x in specs:
        if not all(x.partition("=")):
            raise ValueError(f"not a spec: {x!r}")
    return spark.createDataFrame([(x,) for x in specs], "spec string").select(run_spec(F.col("spec")).alias("r")).select("r.*")


def config(text: str) -> dict:
    """Flat and one-level nested `key: value` settings: numbers, true and false, null, quoted and plain text, [a, b] lists."""

    def value(x: str):
        x = x.strip()
        if x[:1] == "[" and x[-1:] == "]":
            return [value(y) for y in x[1:-1].split(",") if y.strip()]
        if x[:1] in "'\"" and x[-1:] == x[:1] and len(x) > 1:
            return x[1:-1]
        if x.lower() in ("true", "false"):
            return x.lower() == "true"
        if x in ("", "null", "~"):
            return None
        for kind in (int, float):
            try:
                return kind(x)
            except ValueError:
                pass
        return x

    out: dict = {}
    inner = out
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not line:
            continue
        key, sign, rest = line.strip().partition(":")
        if not sign:
            raise ValueError(f"no setting: {line!r}")
        if line[0] not in " \t":
            inner = out
            if not rest.strip():
                inner = out[key] = {}
                continue
        inner[key] = value(rest)
    return out


def rehashed(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, upstream, sha256, matches): the hash that a manifest states and that of the file; null where there is no file."""
    f = files.select("path", "sha256")
    m = manifest.select("path", F.col("sha256").alias("upstream"))
    return m.join(f, "path", "left").withColumn("matches", F.col("upstream").eqNullSafe(F.col("sha256")))


def first_copies(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order."""
    first = df.groupBy(*key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__x"))
    return first.select("__x.*")
