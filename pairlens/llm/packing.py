"""Best-fit packing of documents into sequences of bounded length, in a hierarchy.

Every task encodes its documents, cuts those longer than a sequence (the first
piece takes the remainder, the others are full) and packs the pieces of a window
best-fit decreasing.  Bins that are full or nearly so are final.  The rest become
items themselves: groups of underfull bins are packed best-fit again, in fewer
and fewer groups, until one group is left.  A bin takes another one's content
behind its own, so places move by one shift.

Best fit leaves a group at most one bin that is half full or less, and two bins
over a half never meet.  So after a round of g groups with s such small bins, a
bin whose room is below the smallest of them is final, and of the bins with equal
room s at most can take one: the others are final too.  What remains shrinks from
round to round, and no group sees more than about GROUP bins.

Ids are those of the tokenizer file: the strings of its special tokens inside a
text are their ids, as its library gives them.  Pieces are merged by tiktoken from
the file's vocabulary; texts whose white space or signs run on too long for its
pattern are split by bpe.py.

Defined cases: a null or empty text is one piece with the end id alone; repeated
rows are packed each; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.llm.bpe import encoder, load_ranks
from pairlens.llm.common import small_side, stored

LENGTH = 1024
END_ID = 2
#: Documents that a task packs at once, and bins that a group of a later round has, about.
WINDOW, GROUP = 20_000, 20_000
#: A bin with at most this room left is final.
SLACK = 8


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item and the filled size of each bin; items are taken by falling size.

    Each goes where it leaves the least room; a bit mask over the rooms of open
    bins finds that place in one step.
    """
    bins, filled = np.zeros(len(sizes), np.int64), []
    open_by_room: list[list[int]] = [[] for _ in range(length + 1)]
    mask = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                mask &= ~(1 << room)
            filled[b] += size
        else:
            b, room = len(filled), length
            filled.append(size)
        bins[k] = b
        left = room - size
        if left:
            open_by_room[left].append(b)
            mask |= 1 << left
    return bins, np.array(filled, np.int64)


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, the remainder first."""
    first = n % length
    starts = ([0] if first else []) + list(range(first, n, length))
    return [(a, min(first, length) if a == 0 and first else length) for a in starts]


@lru_cache(4)
def ids_of(path: str) -> Callable[[str], np.ndarray]:
    """Text -> ids by the byte-level vocabulary of a .json tokenizer, special tokens in the text included."""
    with open(path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
    fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens=special)

    def ids(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # the pattern gives up on runs of a million signs
            first = min(special, key=lambda x: (text.find(x) % (len(text) + 1), -len(x)), default=None)
            if first is None or first not in text:
                return np.frombuffer(encoder(path).encode_batch([text])[0], "<u4")
            a, b = text.split(first, 1)
            return np.concatenate([ids(a), np.array([special[first]], "<u4"), ids(b)])

    return ids


PIECES = "doc_id {kind}, piece int, start long, length long, {payload}, bin long, offset long, filled long"


def pieces_of(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False, window: int = WINDOW) -> DataFrame:
    """The pieces of every document with their bin in the task's own packing; PIECES.

    The payload is the ids, or their CRC-32 as little-endian unsigned 32-bit integers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([END_ID], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, number = ids_of(path), TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def packed(number: int) -> pa.RecordBatch:
            doc, piece, start, size, payload = zip(*rows, strict=True)
            bins, filled = best_fit(np.array(size), length)
            order = np.argsort(bins, kind="stable")
            run_up = np.cumsum(np.array(size)[order]) - np.array(size)[order]
            first = np.flatnonzero(np.r_[True, np.diff(bins[order]) > 0])
            offset = np.zeros(len(size), np.int64)
            offset[order] = run_up - np.repeat(run_up[first], np.diff(np.r_[first, len(size)]))
            cols = [
                pa.array(doc, kind_arrow), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                pa.array(payload, pa.list_(pa.int32()) if with_ids else pa.int64()), pa.array(number + bins), pa.array(offset), pa.array(filled[bins]),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids" if with_ids else "ids_crc32", "bin", "offset", "filled"])

        seen, kind_arrow = 0, pa.int64()
        for b in batches:
            kind_arrow = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encode(text or ""), end])
                for piece, (start, size) in enumerate(cut(len(ids), length)):
                    own = ids[start : start + size]
                    rows.append((doc, piece, start, size, own.astype(np.int32) if with_ids else zlib.crc32(own.astype("<u4", copy=False).tobytes())))
                seen += 1
                if seen >= window:
                    yield packed(number)
                    number, rows, seen = number + len(rows), [], 0
        if rows:
            yield packed(number)

    payload = "ids array<int>" if with_ids else "ids_crc32 long"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, PIECES.format(kind=kind, payload=payload))


BINS = "root long, filled long, bins array<long>, shifts array<long>"


def merge_round(open_bins: DataFrame, groups: int, length: int = LENGTH) -> DataFrame:
    """Pack underfull bins (BINS) best-fit into each other within each of `groups` groups."""

    def run(part: pa.Table) -> pa.Table:
        order = np.argsort(part.column("root").to_numpy(), kind="stable")
        part = part.take(pa.array(order))
        filled = part.column("filled").to_numpy()
        root, bins, shifts = part.column("root").to_pylist(), part.column("bins").to_pylist(), part.column("shifts").to_pylist()
        into, total = best_fit(filled, length)
        out: list[list] = [[None, int(t), [], [], 0] for t in total]
        for k, b in enumerate(into.tolist()):
            o = out[b]
            o[0] = root[k] if o[0] is None else o[0]
            o[2] += bins[k]
            o[3] += [s + o[4] for s in shifts[k]]
            o[4] += int(filled[k])
        cols = [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int64())), pa.array([o[3] for o in out], pa.list_(pa.int64()))]
        return pa.table(cols, names=["root", "filled", "bins", "shifts"])

    return open_bins.groupBy(F.pmod(F.xxhash64("root"), F.lit(groups)).alias("g")).applyInArrow(run, BINS)


def remaining(after: DataFrame, groups: int, length: int, slack: int) -> DataFrame:
    """The bins of a round (BINS) with column `open`: whether another round can still change them."""
    small = F.col("filled") <= length // 2
    least, s = after.agg(F.min(F.when(small, F.col("filled"))), F.count(F.when(small, 1))).first()
    room = F.lit(length) - F.col("filled")
    if s < 1 or groups == 1:
        return after.withColumn("open", F.lit(False))
    can = (room > slack) & (small | (room >= least))
    # rank of a bin among those of equal room: its place in its hash part behind the parts before
    part = after.select("root", "filled", F.pmod(F.xxhash64("root", F.lit(groups)), F.lit(groups)).alias("p"), can.alias("can"), small.alias("small"))
    before = part.where("can").groupBy("filled", "p").agg(F.count("*").alias("n"))
    before = before.select("filled", "p", (F.sum("n").over(Window.partitionBy("filled").orderBy("p")) - F.col("n")).alias("before"))
    own = part.where("can").withColumn("nth", F.row_number().over(Window.partitionBy("filled", "p").orderBy("root")))
    go = own.join(before, ["filled", "p"]).where(F.col("small") | (F.col("before") + F.col("nth") <= s)).select("root")
    return after.join(go.withColumn("open", F.lit(True)), "root", "left").withColumn("open", F.coalesce("open", F.lit(False)))


def merged(pieces: DataFrame, length: int = LENGTH, slack: int = SLACK, group: int = GROUP) -> DataFrame:
    """(bin, root, shift) for every underfull bin of pieces."""
    spark = pieces.sparkSession
    under = pieces.where(F.col("filled") < length - slack).groupBy("bin").agg(F.max("filled").alias("filled"))
    now = stored(under.select(F.col("bin").alias("root"), "filled", F.array("bin").alias("bins"), F.array(F.lit(0).cast("long")).alias("shifts")), "open")
    n, found = now.count(), []
    groups = 2 * -(-n // group)
    while n:
        groups = max(1, min(-(-n // group), groups // 2))
        after = stored(merge_round(now, groups, length), "merged")
        after = stored(remaining(after, groups, length, slack), "round")
        found.append(after.where("not open").drop("open"))
        now = after.where("open").drop("open")
        n = now.count()
    if not found:
        return spark.createDataFrame([], "bin long, root long, shift long")
    done = found[0]
    for d in found[1:]:
        done = done.unionByName(d)
    return done.select("root", F.explode(F.arrays_zip("bins", "shifts")).alias("x")).select(F.col("x.bins").alias("bin"), "root", F.col("x.shifts").alias("shift"))


def pack(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids (or ids_crc32), sequence_id and offset for every piece of docs (doc_id, text)."""
    pieces = stored(pieces_of(docs, path, length, with_ids, window), "pieces")
    moves = small_side(stored(merged(pieces, length, group=group), "moves"))
    return pieces.join(moves, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids" if with_ids else "ids_crc32",
        F.coalesce("root", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
