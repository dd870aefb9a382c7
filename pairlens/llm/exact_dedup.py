"""Exact dedup: a log-structured merge index of text digests with byte verification.

Every task fills a memtable (digest -> identifiers, texts held to verify hits in
it byte by byte) and flushes it, sorted by digest, as a run with a filter in the
shared folder.  The filter holds the cells (32 bits) of the run's digests.  Filters
are consulted before any entry moves: an entry whose cell no other run has is alone
and stays where it is.  Compaction then merges the other entries of a digest range
level by level: a bit filter on the larger level tells which digests can be in it
at all, a binary search finds those that are, and each digest keeps one identifier
and a count.  Where more cells are shared than may be broadcast, all entries go.
Hits across runs are verified on whole texts before they count; entries whose
bytes differ from the kept text's (digest collisions) are compacted again among
themselves until none is left.

A run holds each digest once, so a text that fills a third of the table reaches
compaction as one entry a run.  Members stay in their run's entries (bounded by
the memtable) and are joined to their class by (run, digest), never by digest.

Defined cases: null texts equal empty ones; the largest doc_id stays, a null id
only where a group has no other; rows that repeat a doc_id and its text share
the flag; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import BROADCAST_ROWS, small_side, stored

#: A memtable is flushed at this many rows or bytes of text.
MEMTABLE_ROWS, MEMTABLE_BYTES = 20_000, 32 << 20
#: Entries that one compaction task merges, about.
SHARD_ENTRIES = 100_000
FILTER_BITS, FILTER_HASHES = 10, 4

RUNS = "run long, digest binary, variant int, top long, n long, members array<long>, cell int, filter binary"
_RUNS_ARROW = pa.schema(
    [("run", pa.int64()), ("digest", pa.binary()), ("variant", pa.int32()), ("top", pa.int64()), ("n", pa.int64()), ("members", pa.list_(pa.int64())), ("cell", pa.int32()), ("filter", pa.binary())]
)


def sha256(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()


def _largest(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


class Memtable:
    def __init__(self, digest: Callable[[bytes], bytes]):
        self.digest, self.rows, self.bytes = digest, 0, 0
        self.found: dict[bytes, list[list]] = {}

    def add(self, doc_id: int | None, text: str | None) -> None:
        raw = (text or "").encode()
        variants = self.found.setdefault(self.digest(raw), [])
        self.rows += 1
        for v in variants:
            if v[0] == raw:
                v[1] = _largest(v[1], doc_id)
                v[2].append(doc_id)
                return
        self.bytes += len(raw)
        variants.append([raw, doc_id, [doc_id]])

    def flush(self, run: int) -> pa.RecordBatch:
        """The sorted run: an entry for each digest and distinct text, and behind them the run's filter."""
        rows = [(run, d, k, v[1], len(v[2]), v[2], cell_of(d), None) for d in sorted(self.found) for k, v in enumerate(self.found[d])]
        cells = np.unique(np.array([r[6] for r in rows], np.int32))
        rows.append((run, None, None, None, None, None, None, cells.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RUNS_ARROW.types, strict=True)], schema=_RUNS_ARROW)


def cell_of(digest: bytes) -> int:
    """The cell of a digest in the filters."""
    return int.from_bytes(digest[:4].ljust(4, b"\0"), "little", signed=True)


def shared_cells(runs: DataFrame) -> DataFrame:
    """(cell) that the filters of two or more runs hold, or that two texts of one digest in a run do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.frombuffer(x, np.int32) for x in b.column(0).to_pylist()]
            cells, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], names=["cell", "n"])

    found = runs.where("filter is not null").select("filter").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return found.where("n > 1").select("cell").union(runs.where("variant > 0").select("cell")).distinct()


def flush_runs(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256, most_rows: int = MEMTABLE_ROWS, most_bytes: int = MEMTABLE_BYTES) -> DataFrame:
    """Sorted runs of a table with columns doc_id and text; entries as in RUNS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, table = TaskContext.get().partitionId() << 24, Memtable(digest)
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    table.add(i, t)
                if table.rows >= most_rows or table.bytes >= most_bytes:
                    yield table.flush(number)
                    number, table = number + 1, Memtable(digest)
        if table.rows:
            yield table.flush(number)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RUNS)


class Level:
    """Sorted unique digests with the identifier to keep and the rows counted, behind a bit filter."""

    def __init__(self, digests: np.ndarray, top: np.ndarray, n: np.ndarray, entries: np.ndarray):
        self.digests, self.top, self.n, self.entries = digests, top, n, entries
        self.size = max(64, 1 << int(np.ceil(np.log2(max(1, len(digests)) * FILTER_BITS))))
        self.bits = np.zeros(self.size, bool)
        self.bits[self._places(digests).ravel()] = True

    def _places(self, digests: np.ndarray) -> np.ndarray:
        width = digests.dtype.itemsize
        raw = np.frombuffer(digests.tobytes(), np.uint8).reshape(len(digests), width).astype(np.uint64)
        h = np.zeros((len(digests), 2), np.uint64)
        for k in range(width):
            h[:, k % 2] = h[:, k % 2] * np.uint64(0x100000001B3) + raw[:, k]
        h ^= h >> np.uint64(29)
        k = np.arange(FILTER_HASHES, dtype=np.uint64)
        return ((h[:, :1] + k * (h[:, 1:] | np.uint64(1))) % np.uint64(self.size)).astype(np.int64)

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Place of each digest in this level, -1 where it is not: filter first, then binary search."""
        at = np.full(len(digests), -1)
        maybe = np.flatnonzero(self.bits[self._places(digests)].all(1)) if len(digests) and len(self.digests) else np.zeros(0, int)
        if len(maybe):
            k = np.minimum(np.searchsorted(self.digests, digests[maybe]), len(self.digests) - 1)
            hit = self.digests[k] == digests[maybe]
            at[maybe[hit]] = k[hit]
        return at

    def merge(self, other: Level) -> Level:
        at = self.find(other.digests)
        hit = at >= 0
        top, n, entries = self.top.copy(), self.n.copy(), self.entries.copy()
        top[at[hit]] = np.maximum(top[at[hit]], other.top[hit])
        n[at[hit]] += other.n[hit]
        entries[at[hit]] += other.entries[hit]
        d = np.concatenate([self.digests, other.digests[~hit]])
        order = np.argsort(d, kind="stable")
        return Level(d[order], *(np.concatenate([a, b[~hit]])[order] for a, b in ((top, other.top), (n, other.n), (entries, other.entries))))


def level_of(digests: np.ndarray, top: np.ndarray, n: np.ndarray) -> Level:
    """A level from entries in any order; equal digests are folded."""
    order = np.argsort(digests, kind="stable")
    d, t, c = digests[order], top[order], n[order]
    if not len(d):
        return Level(d, t, c, c)
    first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    return Level(d[first], np.maximum.reduceat(t, first), np.add.reduceat(c, first), np.add.reduceat(np.ones_like(c), first))


def compact(runs: list[Level]) -> Level:
    """Merge runs as a size-tiered tree does: a level takes in its neighbour once that is as large."""
    levels: list[Level] = []
    for r in runs:
        levels.append(r)
        while len(levels) > 1 and len(levels[-2].digests) <= 2 * len(levels[-1].digests):
            small = levels.pop()
            levels[-1] = levels[-1].merge(small)
    while len(levels) > 1:
        small = levels.pop()
        levels[-1] = levels[-1].merge(small)
    return levels[0]


#: Stands for a null id inside compaction: below every id but itself.
_NO_ID = int(np.iinfo(np.int64).min)


def compaction(entries: DataFrame) -> DataFrame:
    """(digest, keep, entries) for every digest, from (run, digest, top, n)."""
    shards = max(1, entries.count() // SHARD_ENTRIES + 1)

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        width = max(part["digest"].map(len))
        d = np.array(part["digest"].tolist(), f"S{width}")
        top = part["top"].to_numpy(np.int64)
        n = part["n"].to_numpy(np.int64)
        order = np.argsort(part["run"].to_numpy(), kind="stable")
        cuts = np.flatnonzero(np.diff(part["run"].to_numpy()[order])) + 1
        out = compact([level_of(d[k], top[k], n[k]) for k in np.split(order, cuts)])
        raw = [x.ljust(width, b"\0") for x in out.digests.tolist()]
        return pd.DataFrame({"digest": raw, "keep": out.top, "entries": out.entries})

    part = entries.select("run", "digest", "top", "n")
    return part.groupBy(F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")).applyInPandas(merge, "digest binary, keep long, entries long")


def texts_of(docs: DataFrame, ids: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    """(top, digest, text) for the rows of docs whose id is in ids (top)."""
    met = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("top"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = met.join(small_side(ids.select("top").distinct()), "top", "left_semi")
    own = F.unhex(F.sha2("text", 256)) if digest is sha256 else F.udf(lambda t: digest(t.encode()), "binary")("text")
    return met.withColumn("digest", own)


def classes(docs: DataFrame, runs: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    """(run, digest, variant, keep, size) for the entries whose digest other entries have too, bytes verified."""
    pending = runs.where("filter is null").select("run", "digest", "variant", F.coalesce("top", F.lit(_NO_ID)).alias("top"), "n", "cell")
    met = stored(shared_cells(runs), "cells")
    if met.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        pending = pending.join(F.broadcast(met), "cell", "left_semi")
    pending = pending.drop("cell")
    done = None
    while True:
        shared = compaction(stored(pending, "entries")).where(F.col("entries") > 1).select("digest", "keep")
        hits = stored(pending.join(shared, "digest"), "hits")
        ids = hits.select("top").union(hits.select("keep"))
        texts = texts_of(docs, ids, digest)
        keepers = (
            hits.select("digest", "keep").distinct()
            .join(texts.withColumnRenamed("top", "keep"), ["digest", "keep"])
            .groupBy("digest").agg(F.max("text").alias("keep_text"))
        )
        judged = (
            hits.join(texts, ["digest", "top"]).join(keepers, "digest")
            .groupBy("run", "digest", "variant", "top", "n", "keep")
            .agg(F.max(F.col("text") == F.col("keep_text")).alias("same"))
        )
        judged = stored(judged, "judged")
        sizes = judged.where("same").groupBy("digest").agg(F.sum("n").alias("size"))
        found = judged.where("same").join(sizes, "digest").select("run", "digest", "variant", "keep", "size")
        done = found if done is None else done.unionByName(found)
        pending = judged.where("not same").select("run", "digest", "variant", "top", "n")
        if pending.limit(1).count() == 0:
            return done.withColumn("keep", F.when(F.col("keep") != _NO_ID, F.col("keep")))


def deduplicate(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256, most_rows: int = MEMTABLE_ROWS, most_bytes: int = MEMTABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs (doc_id, text)."""
    runs = stored(flush_runs(docs, digest, most_rows, most_bytes), "runs")
    met = classes(docs, runs, digest)
    out = runs.where("filter is null").join(met, ["run", "digest", "variant"], "left")
    keep = F.when(F.col("size").isNull(), F.col("top")).otherwise(F.col("keep"))
    return out.select(
        F.explode("members").alias("doc_id"), keep.alias("keep_id"), F.coalesce("size", "n").alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256")
    ).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
