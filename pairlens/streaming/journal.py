"""Append-only journals as streams: keyed intake that keeps every row, running summaries, event-time windows.

A taken journal is a folder of parts, one a micro-batch, named by the batch's
number.  Part n holds the rows whose keys no part before n has, so a batch that is
run again writes the same part again, whatever became of its first attempt.  A
marker names the part that is being written; readers leave that part out.  A lock
file, made by exclusive create, keeps a second writer away.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class JournalError(RuntimeError):
    """A journal that another writer holds, or whose rows contradict what was taken."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def create_exclusive(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this call made the file; false if it was there.  Local files are made by the operating system's exclusive create."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    local = fs.getUri().getScheme() == "file"
    if local and not spark.sparkContext._jvm.java.io.File(p.toUri().getPath()).createNewFile():
        return False
    try:
        out = fs.create(p, local)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


@contextmanager
def writer_lock(spark: SparkSession, out: str) -> Iterator[None]:
    """Hold the folder's lock; a lock that is there is refused and names its owner."""
    path, owner = f"{out}/_writer.lock", spark.sparkContext.applicationId
    if not create_exclusive(spark, path, owner):
        raise JournalError(f"{out} is being written by {read_text(spark, path)}")
    try:
        yield
    finally:
        remove(spark, path)


def parts(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the parts of a taken journal, the pending one included."""
    fs, p = _fs(spark, out)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"part-(\d+)", n)))


def taken(spark: SparkSession, out: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows that were taken; without the part that is pending, or those before part `before`."""
    pending = read_text(spark, f"{out}/_pending")
    keep = [n for n in parts(spark, out) if (n < before if before is not None else str(n) != pending)]
    return spark.read.schema(schema).parquet(*[f"{out}/part-{n:09d}" for n in keep]) if keep else spark.createDataFrame([], schema)


def first_rows(batch: DataFrame, key: list[str]) -> DataFrame:
    """One row a key (null is a key): the smallest by all its columns, so that the choice does not depend on the order of rows."""
    rest = [c for c in batch.columns if c not in key]
    if not rest:
        return batch.distinct()
    return batch.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__row")).select(*key, "__row.*").select(*batch.columns)


def commit(batch: DataFrame, number: int, out: str, key: list[str], frozen: list[str], schema: str) -> None:
    """Part `number`: the rows of a batch whose keys are new.  A known key with other frozen fields is refused."""
    spark, batch = batch.sparkSession, batch.cache()
    try:
        known = taken(spark, out, schema, number).select(*[F.col(k).alias(f"__{k}") for k in dict.fromkeys([*key, *frozen])])
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
        on = same[0]
        for x in same[1:]:
            on = on & x
        if frozen:
            changed = ~F.lit(True)
            for f in frozen:
                changed = changed | ~F.col(f).eqNullSafe(F.col(f"__{f}"))
            inside = batch.groupBy(*key).agg(*[(F.count_distinct(f) + F.max(F.col(f).isNull().cast("int"))).alias(f"__{f}") for f in frozen])
            several = F.lit(False)
            for f in frozen:
                several = several | (F.col(f"__{f}") > 1)
            if not batch.join(known, on).where(changed).isEmpty() or not inside.where(several).isEmpty():
                raise JournalError(f"batch {number} has rows whose {', '.join(frozen)} differ from what was taken under their key")
        remove(spark, f"{out}/_pending")
        create_exclusive(spark, f"{out}/_pending", str(number))
        first_rows(batch, key).join(known, on, "left_anti").write.mode("overwrite").parquet(f"{out}/part-{number:09d}")
        remove(spark, f"{out}/_pending")
    finally:
        batch.unpersist()


def intake(spark: SparkSession, path: str, schema: str, key: list[str], out: str, checkpoint: str, frozen: list[str] | None = None, files: int = 50) -> None:
    """Take what lies in a journal and is not yet in `out`, every key once, however late or often its rows come; a further call goes on.

    `files` is how many files a micro-batch reads.  Batches meet what was taken on
    their keys alone, so a batch reads the key columns (and frozen ones) of `out`.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
    with writer_lock(spark, out):
        fs, begun = _fs(spark, f"{checkpoint}/offsets")
        if parts(spark, out) and not fs.exists(begun):  # its numbers would start again
            raise JournalError(f"{out} was taken under another checkpoint")
        q = rows.writeStream.foreachBatch(lambda b, n: commit(b, n, out, key, frozen or [], schema)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()


def summary(rows: DataFrame, by: list[str], success: str) -> DataFrame:
    """Running counts and rates, for output mode complete."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(success)).alias("hits")).withColumn("rate", F.try_divide(F.col("hits").cast("double"), F.col("n")))


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", kind: str = "parquet") -> None:
    """Process what is there and stop; a second call goes on where this one ended."""
    q = stream.writeStream.outputMode(mode).format(kind).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_summary(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Keep a complete summary in an in-memory table."""
    q = stream.writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed(rows: DataFrame, at: str, by: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Extension: counts in tumbling event-time windows under a watermark."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))
