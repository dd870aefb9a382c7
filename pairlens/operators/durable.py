"""Tables that are kept between the steps of an iterative operator, and a scratch folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master without that setting a temporary folder, elsewhere an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='pairlens-')}")
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends (results may be read from it until then)."""
    path = f"{shared(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_all)
    _made.append((spark, path))
    return path


def _remove_all() -> None:
    for spark, path in _made:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be stopped already  # noqa: BLE001
            continue


def kept(df: DataFrame, tag: str = "step") -> DataFrame:
    """df written once to the shared folder and read back, so that its lineage ends there."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
