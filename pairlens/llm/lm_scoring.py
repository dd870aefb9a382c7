"""LM scoring: a causal self-attention model over subword ids, and a word-count baseline.

Both read a text as its lower-cased words with one space before each, closed by
an end.  One pass over all training documents gathers word counts, counts of
neighbouring ids and all context windows.  The model's classes
and shares (attention.py) come from the neighbour counts.  Its weights start from
a fit on a bounded draw of windows, then every part of all windows trains them once
and the parts are averaged.  Overlapping context windows score each subword once.
The baseline takes every word's count: frequent words (a table of fixed size) are
looked up in place, the others are joined by word.

Defined cases: null and empty texts are the end alone; a null doc_id belongs to
training; repeated rows are scored each and counted each; without training
documents all counts are zero and all subwords equally likely; extra columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm import attention
from pairlens.llm.bpe import encoder, load_ranks
from pairlens.llm.common import bucket, runs, stored, text_runs
from pairlens.llm.near_dedup import mix

HELD = (7, 2)
#: Part of all training windows that the weights are trained on: all; and windows (about) that they start from.
SHARE, START = 1.0, 96_000
#: Windows (about) of one pass before weights are averaged, id vectors of a block, and parts that are added up at once.
PART, ROWS, FAN = 20_000, 512, 32
#: Bytes of texts that are split, counted and encoded together, and ids of windows that are made together, about.
TEXT, IDS = 4_000_000, 100_000
#: Pairs of neighbouring ids that a task counts before it hands them on.
PAIRED = 4_000_000
#: Words, at most, whose counts travel to every task; all others are joined.
FREQUENT = 150_000

#: White space that does not part words.
WIDE = re.compile(r"[^\S ]")


@lru_cache(2)
def vocabulary(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """Encoding of a rank file, and how many bytes each id has."""
    ranks = load_ranks(path)
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    width[list(ranks.values())] = [len(x) for x in ranks]
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), width


def end_of(path: str) -> int:
    """The id of an end: the one behind the vocabulary."""
    return len(vocabulary(path)[1])


def subwords(words: list[str], size: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words (size: their bytes) one after the other, each word with a space before it, and how many each has."""
    encoding, width = vocabulary(path)

    def alone(text: str) -> np.ndarray:
        try:
            return np.array(encoding.encode_ordinary(text), np.uint32)
        except ValueError:  # the pattern gives up on runs of a million signs
            return np.frombuffer(encoder(path).encode_batch([text])[0], "<u4")

    text = " " + " ".join(words)
    if WIDE.search(text) or size.max(initial=0) > 1000:
        # a word that white space beyond ASCII opens or closes could share a piece with its neighbour
        each = [alone(" " + w) for w in words]
        return np.concatenate(each), np.array([len(x) for x in each])
    if not words:
        return np.zeros(0, np.uint32), size
    ids = alone(text)
    return ids, np.diff(np.searchsorted(np.cumsum(width[ids]), np.cumsum(size + 1)) + 1, prepend=0)


class Part:
    """Some texts as numbers of their distinct words, each text between two ends, and as subword ids."""

    def __init__(self, texts: pa.Array, path: str):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        values, at = lists.flatten(), lists.offsets.to_numpy()
        full = pc.not_equal(values, "")
        found = values.filter(full).dictionary_encode()
        begin = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[at]
        self.path, self.many = path, np.diff(begin)
        self.names = found.dictionary
        self.words: list[str] = self.names.to_pylist()
        self.owner = np.repeat(np.arange(len(texts)), self.many + 2)
        self.begin = begin + 2 * np.arange(len(begin))
        inside = np.ones(len(self.owner), bool)
        inside[self.begin[:-1]] = inside[self.begin[1:] - 1] = False
        self.numbers = np.full(len(self.owner), len(self.words))  # an end has the number behind all words
        self.numbers[inside] = found.indices.to_numpy()

    def sequences(self) -> list[np.ndarray]:
        """Ids of each text between two ends."""
        ids, sizes = subwords(self.words, pc.binary_length(self.names).to_numpy().astype(np.int64), self.path)
        ids, sizes = np.append(ids, np.uint32(end_of(self.path))), np.append(sizes, 1)
        n = sizes[self.numbers]
        at = np.cumsum(n) - n
        ids = ids[np.repeat((np.cumsum(sizes) - sizes)[self.numbers] - at, n) + np.arange(n.sum())]
        return np.split(ids, at[self.begin[1:-1]]) if len(self.many) else []


def parts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, Part]]:
    """(ids, Part) for runs of rows (doc_id, text)."""
    for b in batches:
        for own in text_runs(b, most=TEXT):
            yield own.column(0), Part(own.column(1), path)


GATHERED = pa.schema([("word", pa.binary()), ("before", pa.int32()), ("own", pa.int32()), ("c", pa.int64()), ("key", pa.int64()), ("ids", pa.binary())])


def gathered(docs: DataFrame, path: str, share: float) -> DataFrame:
    """One pass over all texts of docs: (word, c), (before, own, c) counts of neighbouring ids, and (key, ids) for drawn windows.

    Windows cover every text from end to end; each is drawn with probability `share` by a hash of doc_id and place.
    """
    size, least = end_of(path) + 1, min(1 << 32, int(share * (1 << 32)))

    def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in GATHERED], schema=GATHERED)

    def paired(held: list[np.ndarray]) -> pa.RecordBatch:
        code, c = np.unique(np.concatenate(held), return_counts=True)
        return rows(len(code), before=pa.array((code // size).astype(np.int32)), own=pa.array((code % size).astype(np.int32)), c=pa.array(c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for ids, part in parts(batches, path):
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            seen = np.bincount(part.numbers, minlength=len(part.words) + 1)[:-1]
            yield rows(len(seen), word=part.names.cast(pa.binary()), c=pa.array(seen))
            seqs = part.sequences()
            held.append(np.concatenate([s[:-1].astype(np.int64) * size + s[1:] for s in seqs]))
            if sum(map(len, held)) >= PAIRED:
                yield paired(held)
                held = []
            for k in runs(np.array([len(s) for s in seqs]), IDS):
                x, y, _, owner = attention.windows_of(seqs[k], size - 1, overlap=0)
                nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
                key = mix(mix(ids[k][owner]) + nth.astype(np.uint64))
                pick = np.flatnonzero((key >> np.uint64(32)) < least)
                if len(pick):
                    kept = np.concatenate([x[pick], y[pick, -1:]], 1).astype(np.int32)
                    yield rows(len(pick), key=pa.array(key[pick].view(np.int64)), ids=pa.array([x.tobytes() for x in kept], pa.binary()))
        if held:
            yield paired(held)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word binary, before int, own int, c long, key long, ids binary")


def mapped(pairs: DataFrame, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(to[before], own, count) summed over pairs (before, own, c)."""
    shared = pairs.sparkSession.sparkContext.broadcast(to.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[b.column(0).to_numpy()]), b.column(1), b.column(2)], names=["k", "own", "c"])

    got = pairs.mapInArrow(run, "k int, own int, c long").groupBy("k", "own").agg(F.sum("c").alias("c")).toArrow()
    k, own, c = (got.column(x).to_numpy() for x in ("k", "own", "c"))
    order = np.lexsort((own, k))
    return k[order], own[order], c[order]


def averaged(windows: DataFrame, start: dict[str, np.ndarray], class_of: np.ndarray) -> dict[str, np.ndarray]:
    """Weights trained from start on all windows (key, ids): a pass in each part of PART windows at most, then means.

    A row of the id vectors is weighted by its occurrences in a part, all else by the
    part's windows.  Windows stay where they are; a task adds up its own parts.
    """
    shared = windows.sparkSession.sparkContext.broadcast((start, class_of))
    others = [k for k in start if k != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        w, class_of = shared.value
        diff, seen = np.zeros(w["ids"].shape), np.zeros(len(class_of))
        rest, many = np.zeros(sum(w[k].size for k in others)), 0

        def trained(part: list[bytes]) -> None:
            nonlocal rest, many
            x = np.frombuffer(b"".join(part), np.int32).reshape(len(part), -1)
            # neighbouring windows are of one text: a step takes windows from all over the part
            new = attention.refined(w, x[np.random.default_rng(len(x)).permutation(len(x))], class_of)
            here = np.bincount(x[:, :-1].ravel(), minlength=len(class_of))
            diff[:] += (new["ids"] - w["ids"]) * here[:, None]
            seen[:] += here
            rest, many = rest + np.concatenate([(new[k] - w[k]).ravel() for k in others]) * len(x), many + len(x)

        held: list[bytes] = []
        for b in batches:
            held += b.column(1).to_pylist()
            while len(held) >= PART:
                trained(held[:PART])
                held = held[PART:]
        if held:
            trained(held)
        if not many:
            return
        order = TaskContext.get().partitionId()
        raw = lambda x: x.astype(np.float32).tobytes()
        rows = [(-1, order, raw(rest), raw(np.array([many])))]
        rows += [(k, order, raw(diff[k : k + ROWS]), raw(seen[k : k + ROWS])) for k in range(0, len(diff), ROWS) if seen[k : k + ROWS].any()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "part", "diff", "weight"])

    def added(part: pa.Table) -> pa.Table:
        part = part.sort_by([("part", "ascending"), ("diff", "ascending")])
        diff, weight = (sum(np.frombuffer(x, np.float32).astype(float) for x in part.column(c).to_pylist()) for c in ("diff", "weight"))
        cols = [part.column("block")[:1], part.column("part")[:1], *(pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (diff, weight))]
        return pa.table(cols, names=["block", "part", "diff", "weight"])

    row, parts = "block long, part long, diff binary, weight binary", windows.rdd.getNumPartitions()
    # stored, as else every level of the tree would train again
    found = stored(windows.select("key", "ids").mapInArrow(run, row), "trained")
    while True:  # a tree of sums, FAN at a time
        parts = -(-parts // FAN)
        found = found.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(parts))).groupBy("block", "part").applyInArrow(added, row)
        if parts == 1:
            break
    out = {k: v.copy() for k, v in start.items()}
    for r in found.collect():
        weight, at = np.frombuffer(r.weight, np.float32), 0
        diff = (np.frombuffer(r.diff, np.float32).reshape(len(weight), -1) / np.maximum(weight, 1)[:, None]).ravel()
        if r.block >= 0:
            out["ids"][r.block : r.block + ROWS] += diff.reshape(-1, out["ids"].shape[1])
            continue
        for k in others:
            out[k] += diff[at : at + out[k].size].reshape(out[k].shape)
            at += out[k].size
    return out


def fit(all_: DataFrame, path: str) -> attention.Model:
    """The attention model of what `gathered` found."""
    size = end_of(path) + 1
    pairs = stored(all_.where("before is not null").groupBy("before", "own").agg(F.sum("c").alias("c")), "pairs")
    windows = all_.where("ids is not null").select("key", "ids")
    n = windows.count()
    if not n:
        return attention.train(np.zeros((0, attention.WINDOW + 1), np.int32), size)
    before = np.zeros(size)
    for r in pairs.groupBy("before").agg(F.sum("c").alias("c")).collect():
        before[r.before] = r.c
    column, own, times = mapped(pairs, attention.columns_of(before))
    class_of = attention.classes_of(own, column, times, size)
    tables = class_of, *attention.shares_of(class_of, *mapped(pairs, class_of))
    part = min(1 << 30, int(START / n * (1 << 30)))
    first = windows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < part) if part < 1 << 30 else windows
    x = np.frombuffer(b"".join(first.select("ids").toArrow().column(0).to_pylist()), np.int32).reshape(-1, attention.WINDOW + 1)
    start = attention.train(x[np.lexsort(x.T[::-1])], size, tables=tables)
    return attention.Model(averaged(windows, start.weights, class_of), class_of, start.share)


@dataclass
class Scorer:
    path: str
    model: attention.Model
    frequent: dict[str, int]
    train_tokens: int
    distinct: int
    ends: int

    @property
    def floor(self) -> int:
        """What a count plus one is divided by."""
        return self.train_tokens + self.distinct + 1

    def lm(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text, given as its ids between two ends, under the model."""
        out = np.zeros(len(sequences))
        for k in runs(np.array([len(s) for s in sequences]), IDS):
            x, y, counts, owner = attention.windows_of(sequences[k], end_of(self.path))
            out[k] = np.bincount(owner, np.where(counts, self.model.scores(x, y), 0).sum(1), k.stop - k.start)
        return out / np.log(10)


def train(docs: DataFrame, path: str, held: tuple[int, int] = HELD) -> tuple[Scorer, DataFrame]:
    """The scorer and the counts of all words (word, c) of the training documents."""
    kept = docs.select("doc_id", F.col("text").cast("string")).where(bucket("doc_id", held[0]) != held[1])
    ends = kept.count()
    all_ = stored(gathered(kept, path, SHARE), "gathered")
    counts = stored(all_.where("word is not null").groupBy("word").agg(F.sum("c").alias("c")), "words")
    # how many words have counts of each size, in steps of a sixteenth of a doubling, tells the least count to look up
    step = F.floor(16 * F.log2("c"))
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).orderBy(F.desc("step")).collect()
    many = np.cumsum([r.v for r in sizes]) <= FREQUENT
    top = counts.where(step >= sizes[int(many.sum()) - 1].step).collect() if many.any() else []
    total = sum(r.n for r in sizes)
    return Scorer(path, fit(all_, path), {r.word.decode(): r.c for r in top}, total + ends, sum(r.v for r in sizes) + (ends > 0), ends), counts


PARTIAL = "key long, doc_id long, n_tokens long, known long, base double, score double, rare array<struct<word:binary,n:long>>"


def score(docs: DataFrame, scorer: Scorer, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s, key = shared.value, TaskContext.get().partitionId() << 40
        for ids, part in parts(batches, s.path):
            n, numbers, words = len(ids), part.numbers, len(part.words)
            c = np.append(np.fromiter(map(s.frequent.get, part.words, repeat(0)), np.int64, words), s.ends)
            times = c[numbers]
            looked = (times > 0) | (numbers == words)
            token = np.ones(len(numbers), bool)
            token[part.begin[:-1]] = False  # the end that opens a text is no token
            base = np.bincount(part.owner, np.where(looked & token, np.log10((times + 1.0) / s.floor), 0), n)
            code, many = np.unique(part.owner[~looked] * (words + 1) + numbers[~looked], return_counts=True)
            whose, which = np.divmod(code, words + 1)
            names = part.names.take(pa.array(which)).cast(pa.binary())
            rare = pa.StructArray.from_arrays([names, pa.array(many, pa.int64())], names=["word", "n"])
            columns = [
                pa.array(range(key, key + n), pa.int64()), ids, pa.array(part.many + 1), pa.array(np.bincount(part.owner, (times > 0) & token, n).astype(np.int64)),
                pa.array(base), pa.array(s.lm(part.sequences())), pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, np.arange(n + 1)), pa.int32()), rare),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "n_tokens", "known", "base", "score", "rare"])
            key += n

    partial = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PARTIAL), "scored")
    seen = partial.select("key", F.explode("rare").alias("x")).select("key", "x.word", "x.n").join(counts, "word", "left")
    rest = seen.groupBy("key").agg(
        F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("n"))), F.lit(0)).alias("more"),
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(scorer.floor)))).alias("low"),
    )
    return partial.drop("rare").join(rest, "key", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("low", F.lit(0.0))).alias("base_score"), "score"
    )


def score_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every document."""
    scorer, counts = train(docs, path)
    return score(docs, scorer, counts).select(
        "doc_id", (bucket("doc_id", HELD[0]) == HELD[1]).alias("held_out"), "n_tokens", "n_known",
        F.lit(int(scorer.train_tokens)).cast("long").alias("train_tokens"), "base_score", "score",
    )
