"""The document pipeline: each stage takes what its predecessor kept and stored.

quality classifier -> quality rules -> exact dedup -> MinHash near-dedup -> packing.
All stages but the last return the columns of documents.  Both quality models
learn from the whole documents table, so the second one sees what the first one
rejects.

Defined cases: null texts are empty, fail the base rules and go; rows with a null
doc_id are judged like others; a row that repeats a doc_id and its text goes as an
exact copy; rows that repeat a doc_id with other texts, or have none, come behind
all others where near copies choose the row that stays; an empty table passes
every stage as an empty table; further columns are kept, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import exact_dedup, near_dedup, packing, quality_classifier, quality_rules
from pairlens.llm.common import new_folder, small_side, stored, table

TOKENIZER = "byte_bpe_50k.json"
#: Documents whose five-word shingles agree on this per cent of their union are near copies.
NEAR_PERCENT = 80
#: Rows up to which a stage's verdict is broadcast.
FEW = 20_000


def unused(docs: DataFrame, name: str) -> str:
    """`name`, made longer until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = unused(docs, "__quality")
    scored = quality_classifier.classify(docs, model, score)
    return scored.where(F.col(score) >= quality_classifier.THRESHOLD).select(*docs.columns)


def keep_regular(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet the base rules and that the boosted trees accept."""
    forest = quality_rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    verdict = unused(docs, "__verdict")
    return quality_rules.judge(docs, forest, out=verdict).where(F.col(verdict)["kept"]).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: one with the largest id."""
    digest, many, own = (unused(docs, x) for x in ("__digest", "__many", "__id"))
    kept = exact_dedup.deduplicate(docs).where("kept").groupBy(F.col("doc_id").alias(own), F.col("text_sha256").alias(digest)).agg(F.count("*").alias(many))
    kept = stored(kept, "kept")
    text = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    met = docs.join(small_side(kept, FEW), (text == F.col(digest)) & F.col("doc_id").eqNullSafe(F.col(own)))
    if kept.where(F.col(many) > 1).limit(1).count():  # an id and text that rows repeat are kept once
        met = met.where(F.col(many) == 1).unionByName(met.where(F.col(many) > 1).dropDuplicates([own, digest]))
    return met.select(*docs.columns)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with column `name`, a number of each row: its doc_id, or beyond all ids for rows whose id is null or not its own."""
    doubt = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id", F.lit(True).alias(name)), "doubt")
    if not doubt.limit(1).count():
        return docs.withColumn(name, F.col("doc_id"))
    top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    met = docs.join(small_side(doubt.withColumnRenamed("doc_id", name + "id")), F.col("doc_id").eqNullSafe(F.col(name + "id")), "left")
    # the numbers are written once, so that no later run of a task deals others
    return stored(met.withColumn(name, F.when(F.col(name), F.monotonically_increasing_id() + 1 + top).otherwise(F.col("doc_id"))).select(*docs.columns, name), "numbered")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest number."""
    number = unused(docs, "__number")
    rows = numbered(docs, number)
    found = near_dedup.near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"), NEAR_PERCENT)
    gone = stored(found.where("not kept").select(F.col("doc_id").alias(number)), "gone")
    return rows.join(small_side(gone, FEW), number, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents, placed in sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", keep_good),
    ("quality rules", keep_regular),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("best-fit packing", pack),
]

#: The stages fit models, tokenise and pack, which SQL cannot state; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, "stage-" + name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
