"""Helpers that the operators share: the shared folder, label samples, broadcasts of checked size."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and the five ASCII controls from tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
#: Rows up to which a two-column key table may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 400_000
#: Keys of a table that may be broadcast because they are hot, or because there are no more.
HOT_KEYS = 20_000

#: Rows of one key that a task of `join_split` holds, at least.
SPLIT_ROWS = 5_000

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only where that is unset on a local master (tests, one machine) a temporary folder takes its place.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='pairlens-')}")
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/pairlens-{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_all)
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_all() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # one folder may be gone already, or the JVM  # noqa: BLE001
            continue


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(col, modulus: int):
    """crc32 of the id as text, modulo; null ids fall in bucket -1."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows (counted), else unchanged."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join_hot(rows: DataFrame, one: DataFrame, key: str, count: str, how: str = "inner", most: int = HOT_KEYS) -> DataFrame:
    """rows joined with `one`, a stored table of one row a key whose column `count` says how many of the rows share it.

    A table of at most `most` keys is broadcast.  Of a larger one only the keys
    that hold more than that part of all counted rows are, which cannot be more
    than `most`; rows of the other keys shuffle, and none of those keys is hot.
    """
    if one.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(one.drop(count)), key, how)
    total = one.agg(F.sum(count)).first()[0]
    hot = F.broadcast(one.where(F.col(count) * most > total).drop(count))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(one.drop(count), key, how))


def split_of(counts: DataFrame, key: str, count: str, rows: int = SPLIT_ROWS) -> DataFrame | None:
    """(key, salts) for the keys of counts that hold many rows: into how many parts each goes; None without such keys.

    A part has `rows` rows, or a HOT_KEYS-th of all where that is more: so there
    are never more than HOT_KEYS such keys, and the table may be broadcast.
    """
    held = counts.agg(F.sum(count).alias("all"), F.max(count).alias("top")).first()
    most = max(rows, -(-(held["all"] or 0) // HOT_KEYS))
    if (held["top"] or 0) <= most:
        return None
    return F.broadcast(counts.where(F.col(count) > most).select(key, F.ceil(F.col(count) / most).cast("int").alias("__salts")))


def join_split(rows: DataFrame, one: DataFrame, key: str, spread: str, hot: DataFrame | None) -> DataFrame:
    """rows joined with `one` (one row a key) where a key may hold any part of the rows; hot: the keys by `split_of`.

    The rows of a hot key are dealt over parts by the column `spread`, and its row of
    `one` goes to each part: no task holds more than a part, and nothing but the
    list of hot keys is broadcast.
    """
    if hot is None:
        return rows.join(one, key)
    salts = F.coalesce("__salts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("__salts")
    copies = one.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return dealt.join(copies, [key, "__salt"]).drop("__salt")


def runs(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices whose sizes add up to about `most`."""
    if len(sizes):
        group = (np.cumsum(sizes) - sizes) // most
        cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
        yield from map(slice, cuts[:-1], cuts[1:])


def text_runs(b: pa.RecordBatch, column: int = 1, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `most` bytes."""
    for k in runs(pc.binary_length(b.column(column)).fill_null(0).to_numpy() + 16, most):
        yield b.slice(k.start, k.stop - k.start)


def label_sample(labels: DataFrame, label: str, modulus: int, held: int, bound: int, seed: int = 1) -> DataFrame:
    """(doc_id, y): one row a labelled document outside the held-out bucket, about `bound` at most.

    A document with several labels takes the rounded mean (ties are 1); null ids
    and null labels are left out.  Which documents are taken depends on a hash of
    the id, so the sample is the same wherever the rows lie.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("double").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (bucket("doc_id", modulus) != held))
        .groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )
    n = known.count()
    if n <= bound:
        return known
    part = int(bound / n * (1 << 30))
    return known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < part)
