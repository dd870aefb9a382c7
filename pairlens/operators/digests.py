"""Digests of ordered sets and sequences of any size.

Rows are sorted in ranges, all ranges at once; every task joins its sorted lines to
chunks.  The digest of a group is one hash over its chunks in order, fed chunk by
chunk: no array of a group's ids is ever built, and memory stays that of a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.operators.durable import kept

#: Bytes of a chunk, about.
CHUNK = 1 << 20


def sequence_digests(df: DataFrame, by: str, order: list, value: Column, terminal: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(by, sha256, lines): digest of a group's values in order, joined by newlines, with one more behind the last if `terminal`.

    The order must be total where values differ; null values are left out.
    """
    rows = df.select(F.col(by).alias("__by"), *[(F.col(c) if isinstance(c, str) else c).alias(f"__o{k}") for k, c in enumerate(order)], value.cast("string").alias("__v")).where("__v is not null")
    keys = ["__by", *[f"__o{k}" for k in range(len(order))], "__v"]
    kind = rows.schema["__by"].dataType

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, group, lines, size = TaskContext.get().partitionId(), 0, None, [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, lines, size
            out = pa.RecordBatch.from_pydict({"__by": pa.array([group], arrow), "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int64()), "lines": pa.array([len(lines)], pa.int64()), "body": pa.array(["\n".join(lines).encode()], pa.binary())})
            number, lines, size = number + 1, [], 0
            return out

        for b in batches:
            arrow = b.schema.field(0).type
            for g, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lines and (g != group or size >= chunk):
                    yield close()
                group = g
                lines.append(v)
                size += len(v) + 1
        if lines:
            yield close()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, digest, lines, arrow = None, None, 0, None

        def done() -> pa.RecordBatch:
            if terminal:
                digest.update(b"\n")
            return pa.RecordBatch.from_pydict({"__by": pa.array([group], arrow), "sha256": pa.array([digest.hexdigest()]), "lines": pa.array([lines], pa.int64())})

        for b in batches:
            arrow = b.schema.field(0).type
            for k in range(b.num_rows):
                g = b.column(0)[k].as_py()
                if digest is None or g != group:
                    if digest is not None:
                        yield done()
                    group, digest, lines = g, hashlib.sha256(), 0
                elif lines:
                    digest.update(b"\n")
                digest.update(b.column(2)[k].as_buffer())
                lines += b.column(1)[k].as_py()
        if digest is not None:
            yield done()

    schema = T.StructType([T.StructField("__by", kind), *T.StructType.fromDDL("part int, number long, lines long, body binary").fields])
    made = kept(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("__by", "__v").mapInArrow(chunks, schema), "chunks")
    out = T.StructType([T.StructField("__by", kind), *T.StructType.fromDDL("sha256 string, lines long").fields])
    one = made.repartition("__by").sortWithinPartitions("__by", "part", "number").select("__by", "lines", "body").mapInArrow(fold, out)
    return one.withColumnRenamed("__by", by)


def set_digests(df: DataFrame, by: str, ids: str, chunk: int = CHUNK) -> DataFrame:
    """(by, sha256, lines): digest of a group's sorted distinct ids as text, each on a line of its own."""
    own = df.select(by, F.col(ids).cast("string").alias("__id")).where("__id is not null").distinct()
    return sequence_digests(own, by, ["__id"], F.col("__id"), True, chunk)
