"""Deterministic experiment views over the test tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions.hashing import bucket

MODELS = ["m0", "m1", "m2", "m3"]
STATES = ["source_absent", "record_true", "record_false"]
CUES = ["values_only", "authority", "explicit_conclusion"]
FIVE = ["clean_false", "clean_true", "flat_false", "scene_false", "scene_true"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, or as it has, for rows that are few bytes but much work: a file may be one split."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def literals(spark: SparkSession, name: str, values: list) -> DataFrame:
    """One-column table of a fixed list, small by construction."""
    return F.broadcast(spark.createDataFrame([(v,) for v in values], f"{name} {'string' if isinstance(values[0], str) else 'int'}"))


def bands(b: Column, cuts: list[tuple[int, str | None]]) -> Column:
    """The first label whose bound exceeds b."""
    out = None
    for bound, label in cuts:
        out = F.when(b < bound, F.lit(label)) if out is None else out.when(b < bound, F.lit(label))
    return out


def sql_bands(b: str, cuts: list[tuple[int, str | None]]) -> str:
    return "case " + " ".join(f"when {b} < {n} then {'null' if x is None else repr(x)}" for n, x in cuts) + " end"


def sql_bucket(n: int, *parts: str) -> str:
    return f"(('0x' || substr(sha256(concat_ws(':', {', '.join(parts)})), 1, 8))::ubigint % {n})::bigint"


def sql_list(name: str, values: list) -> str:
    return f"(select unnest([{', '.join(repr(v) for v in values)}]) as {name})"


ABSENT = [(70, "absent"), (85, "inconsistent"), (95, "consistent"), (100, None)]
TRUE = [(75, "consistent"), (90, "inconsistent"), (96, "absent"), (100, None)]
FALSE = [(40, "inconsistent"), (85, "consistent"), (95, "absent"), (100, None)]


def runs3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, model and state: the parsed decision, whether the record was read, the knowledge answer."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("family"), "source")
    cells = items.crossJoin(literals(spark, "model", MODELS)).crossJoin(literals(spark, "condition", STATES))
    b = F.col("b")
    cells = cells.withColumn("b", bucket(100, "run3", F.col("model"), F.col("item_id"), F.col("condition")))
    decide = F.when(F.col("condition") == "source_absent", bands(b, ABSENT)).when(F.col("condition") == "record_true", bands(b, TRUE)).otherwise(bands(b, FALSE))
    side = bucket(100, "side3", F.col("model"), F.col("item_id"), F.col("condition"))
    return cells.withColumn("decide", decide).withColumn("side", side).select(
        "model", "item_id", "family", "source", "condition", "decide",
        F.when(F.col("condition") == "record_false", bands(F.col("side"), [(80, "y"), (93, "n"), (100, None)]) == "y").alias("read_match"),
        F.when(F.col("condition") == "record_false", bands(F.col("side") % 50, [(40, "consistent"), (48, "inconsistent"), (50, None)])).alias("knowledge"),
    )


RUNS3 = f"""
    cells3 as (
        select doc_id as item_id, lang as family, source, model, condition,
               {sql_bucket(100, "'run3'", "model", "doc_id", "condition")} as b, {sql_bucket(100, "'side3'", "model", "doc_id", "condition")} as side
        from documents, {sql_list("model", MODELS)} m, {sql_list("condition", STATES)} c
    ), runs3 as (
        select model, item_id, family, source, condition,
               case condition when 'source_absent' then {sql_bands("b", ABSENT)} when 'record_true' then {sql_bands("b", TRUE)} else {sql_bands("b", FALSE)} end as decide,
               case when condition = 'record_false' then case when side < 80 then true when side < 93 then false end end as read_match,
               case when condition = 'record_false' then {sql_bands("side % 50", [(40, "consistent"), (48, "inconsistent"), (50, None)])} end as knowledge
        from cells3
    )"""

TRUTH6 = [(70, "consistent"), (88, "inconsistent"), (100, None)]


def runs6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, model, cue and truth: the decision, whether the cue was read, and the knowledge answer."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("family"))
    cells = items.crossJoin(literals(spark, "model", MODELS)).crossJoin(literals(spark, "cue", CUES)).crossJoin(literals(spark, "truth", ["true", "false"]))
    cells = cells.withColumn("b", bucket(100, "run6", F.col("model"), F.col("item_id"), F.col("cue"), F.col("truth")))
    cells = cells.withColumn("s", bucket(100, "side6", F.col("model"), F.col("item_id"), F.col("cue"), F.col("truth")))
    gold = F.when(F.col("truth") == "true", "consistent").otherwise("inconsistent")
    hit = F.when(F.col("truth") == "true", F.col("b") < 78).otherwise(F.col("b") < 55)
    decide = F.when(F.col("b") >= 95, None).when(hit, gold).otherwise(F.when(gold == "consistent", "inconsistent").otherwise("consistent"))
    return cells.select(
        "model", "item_id", "family", F.when(bucket(2, "polarity", F.col("item_id")) == 0, "direct").otherwise("reverse").alias("polarity"),
        "cue", "truth", F.concat_ws("_", "cue", "truth").alias("condition"), gold.alias("gold"), decide.alias("decide"),
        F.when(F.col("s") < 85, True).when(F.col("s") < 97, False).alias("read_match"), (F.col("s") % 10 < 8).alias("knows"),
    )


RUNS6 = f"""
    cells6 as (
        select doc_id as item_id, lang as family, model, cue, truth, case truth when 'true' then 'consistent' else 'inconsistent' end as gold,
               {sql_bucket(100, "'run6'", "model", "doc_id", "cue", "truth")} as b, {sql_bucket(100, "'side6'", "model", "doc_id", "cue", "truth")} as s
        from documents, {sql_list("model", MODELS)} m, {sql_list("cue", CUES)} q, {sql_list("truth", ["true", "false"])} t
    ), runs6 as (
        select model, item_id, family, case when {sql_bucket(2, "'polarity'", "item_id")} = 0 then 'direct' else 'reverse' end as polarity,
               cue, truth, cue || '_' || truth as condition, gold,
               case when b >= 95 then null when b < case truth when 'true' then 78 else 55 end then gold
                    when gold = 'consistent' then 'inconsistent' else 'consistent' end as decide,
               case when s < 85 then true when s < 97 then false end as read_match, s % 10 < 8 as knows
        from cells6
    )"""


def runs5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, model and condition of five: parsed answer, exact read, and a cell of six."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("family"))
    cells = items.crossJoin(literals(spark, "model", MODELS)).crossJoin(literals(spark, "condition", FIVE))
    b = bucket(100, "run5", F.col("model"), F.col("item_id"), F.col("condition"))
    s = bucket(100, "read5", F.col("model"), F.col("item_id"), F.col("condition"))
    cells = cells.withColumn("b", b).withColumn("s", s)
    clean = F.col("condition").startswith("clean")
    truth = F.col("condition").endswith("true")
    correct = F.when(clean, F.col("b") < 82).when(truth, F.col("b") < 75).otherwise(F.col("b") < 60)
    gold = F.when(truth, "consistent").otherwise("inconsistent")
    other = F.when(truth, "inconsistent").otherwise("consistent")
    return cells.select(
        "model", "item_id", "family", bucket(6, "cell", F.col("item_id")).alias("cell"), "condition",
        F.when(F.col("b") >= 96, None).when(correct, gold).otherwise(other).alias("parsed"), gold.alias("gold"), (F.col("s") < 88).alias("exact_read"),
    )


RUNS5 = f"""
    cells5 as (
        select doc_id as item_id, lang as family, model, condition, {sql_bucket(6, "'cell'", "doc_id")} as cell, condition like '%true' as truth, condition like 'clean%' as clean,
               {sql_bucket(100, "'run5'", "model", "doc_id", "condition")} as b, {sql_bucket(100, "'read5'", "model", "doc_id", "condition")} as s
        from documents, {sql_list("model", MODELS)} m, {sql_list("condition", FIVE)} c
    ), runs5 as (
        select model, item_id, family, cell, condition,
               case when b >= 96 then null when (b < case when clean then 82 when truth then 75 else 60 end) = truth then 'consistent' else 'inconsistent' end as parsed,
               case when truth then 'consistent' else 'inconsistent' end as gold, s < 88 as exact_read
        from cells5
    )"""
