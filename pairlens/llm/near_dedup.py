"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set holds its distinct five-word shingles.  Sketch: in round i every
shingle is thrown into one of t bins with the value (i, hash); a bin keeps the
smallest value.  The first t rounds choose bins by hash, round t + j throws every
shingle into bin j, so all coordinates fill; rounds end when no bin is empty.
Two sketches agree at a coordinate with the probability of their sets' Jaccard
similarity, with concentration as of independent hashes.

Links: identical sets share a representative.  Coordinates are cut into bands;
in every bucket of a band all members are compared with one pivot (another one
in each bucket), exactly, on full sets.  Documents so linked form components; a
bucket that still holds several of them goes on: documents that meet in such
buckets form a cluster.  Large clusters meet fresh pivots for some rounds; what then is
not one component is cut into blocks of bounded size, and every pair
of blocks is settled on full sets, where sketches rule out pairs far below the
threshold.  No cap on bucket sizes, and no list of pairs within a group.

Bands and prefilter follow from the threshold.  At 0.85, 30 bands of 6: a pair at
it shares no bucket with probability 7e-7, and its sketch of 180 coordinates falls
below 0.65 with less than 1e-9.  At 0.8, 36 bands of 5 (6e-7) and 0.6.

Defined cases: null and empty texts have empty sets and link with nothing; under
five words the whole sequence is the one shingle; rows with a null doc_id are
their own component (null); rows that repeat a doc_id are one node; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import join_hot, join_split, small_side, split_of, stored, text_runs
from pairlens.llm.components import components

WORDS, BANDS, ROWS = 5, 30, 6
#: Linked from this many per cent of the union on.
PERCENT = 85
#: Pairs whose sketches agree on less than this part are not linked.
SKETCH_LEAST = 0.65
#: Members of a bucket that are compared in one block.
BLOCK = 256
#: Rounds in which large clusters meet a fresh pivot, and pivots whose sets may be broadcast.
ROUNDS, PIVOTS = 8, 200
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15
_U = np.uint64


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows of a band: the longest bands that part a pair at the threshold with 1e-6 at most."""
    p, t = percent / 100, BANDS * ROWS
    return next((t // r, r) for r in range(t, 0, -1) if t % r == 0 and ((1 - p**r) ** (t // r) <= 1e-6 or r == 1))


def sketch_least(percent: int) -> float:
    """What sketches of linked pairs agree on at least, in steps of a twentieth: less with under 1e-9."""
    p, t = percent / 100, BANDS * ROWS
    below = lambda k: sum(comb(t, i) * p**i * (1 - p) ** (t - i) for i in range(-(-t * k // 20)))
    return next(k / 20 for k in range(20, -1, -1) if below(k) < 1e-9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one text."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join(w))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(h) - words + 1
    s = h[:n].copy()
    for k in range(1, words):
        s = mix(s + _U(_STEP)) + h[k : k + n]
    return np.unique(mix(s))


def sketches(sets: list[np.ndarray], t: int = BANDS * ROWS) -> np.ndarray:
    """A row of t values for each set, none of them empty (empty sets give rows of maxima)."""
    sizes = np.array([len(s) for s in sets])
    top = np.iinfo(np.uint64).max
    out = np.full(len(sets) * t, top, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    x = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    for i in range(2 * t):
        if not len(x):
            break
        h = mix(x + _U((i + 1) * _STEP % 2**64))
        bins = ((h >> _U(32)) * _U(t) >> _U(32)).astype(np.int64) if i < t else np.full(len(x), i - t)
        np.minimum.at(out, owner * t + bins, (_U(i) << _U(48)) | (h & _U(0xFFFFFFFFFFFF)) if i < t else (_U(i) << _U(48)) | (h >> _U(16)))
        left = (out.reshape(-1, t) == top).any(1)[owner]
        if not left.all():
            x, owner = x[left], owner[left]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A signed 64-bit key for each band of each sketch; keys of different bands differ."""
    rows = sketch.shape[1] // bands
    part = sketch.reshape(len(sketch), bands, rows)
    key = mix(np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _U(_STEP), part.shape[:2]).copy())
    for k in range(rows):
        key = mix(key + part[:, :, k])
    return key.view(np.int64)


SIGNED = "doc_id long, n_shingles long, sig binary, sketch binary, bands array<long>"


def signatures(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """SIGNED for every row: set size, a 128-bit digest of the set, sketch bytes, band keys (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in text_runs(b):
                sets = [shingle_set(x) for x in part.column(1).to_pylist()]
                sk = sketches(sets)
                keys = band_keys(sk, bands)
                low = (sk & _U(0xFF)).astype(np.uint8)
                full = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if f else None for s, f in zip(sets, full, strict=True)], pa.binary()),
                        pa.array([low[k].tobytes() if f else None for k, f in enumerate(full)], pa.binary()),
                        pa.array([keys[k] if f else None for k, f in enumerate(full)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "sig", "sketch", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SIGNED)


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, members) for the documents whose id is in ids (id): full sets, one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in text_runs(b):
                sets = [shingle_set(x).view(np.int64) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "members"])

    met = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    return met.join(small_side(ids.select("id").distinct()), "id", "left_semi").mapInArrow(run, "id long, members array<long>").dropDuplicates(["id"])


def meets(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether two sets share `percent` of their union."""
    both = np.concatenate([u, v])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def held_by(pairs: DataFrame, key: str) -> DataFrame | None:
    """The hot keys of pairs, for `join_split`."""
    return split_of(pairs.groupBy(key).agg(F.count("*").alias("n")), key, "n")


def verified(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of pairs (a, b) whose full sets meet the threshold."""
    sets = stored(sets_of(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b"))), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            s, t = x.column(2), x.column(3)
            ok = [meets(s[k].values.to_numpy(), t[k].values.to_numpy(), percent) for k in range(x.num_rows)]
            yield x.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    # a pivot may be in any part of the pairs
    joined = join_split(pairs, sets.select(F.col("id").alias("a"), F.col("members").alias("s")), "a", "b", held_by(pairs, "a"))
    joined = join_split(joined, sets.select(F.col("id").alias("b"), F.col("members").alias("t")), "b", "a", held_by(pairs, "b"))
    return joined.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def links_between(left: np.ndarray, right: np.ndarray, comp: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], least: float = SKETCH_LEAST, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between rows of left and of right that join their components into one; every pair is settled.

    Sketches tell which rows of left can have links at all.  For those, an index
    of the shingles of right counts the intersections with all rows at once.  A
    link within what is one component already is not needed.
    """
    up = {int(c): int(c) for c in comp}

    def root(c: int) -> int:
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    near = {}
    for r in left:
        cand = right[comp[right] != comp[r]]
        if len(cand) and (cand := cand[(sketch[cand] == sketch[r]).mean(1) >= least]).size:
            near[int(r)] = cand
    if not near:
        return []
    rows = np.unique(np.concatenate(list(near.values())))
    sizes = np.array([len(sets[k]) for k in rows])
    values, owner = np.concatenate([sets[k] for k in rows]), np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(values, kind="stable")
    owner = owner[order]
    known, first = np.unique(values[order], return_index=True)
    first = np.append(first, len(values))
    out = []
    for r, cand in near.items():
        own = sets[r]
        at = np.searchsorted(known, own)
        at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == own)]
        n = first[at + 1] - first[at]
        places = np.repeat(first[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(at) else np.zeros(0, int)
        common = np.bincount(owner[places], minlength=len(rows))[np.searchsorted(rows, cand)]
        union = len(own) + np.array([len(sets[k]) for k in cand]) - common
        for k in cand[100 * common >= percent * union]:
            a, b = root(int(comp[r])), root(int(comp[k]))
            if a != b:
                up[a] = b
                out.append((r, int(k)))
    return out


def peeled(members: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS, block: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """Links (a, b) of large clusters to fresh pivots, and the members with the components that those links make.

    In each round a cluster of more than `block` members shows one member, drawn
    by a hash and so likely of a large component, to all that are not of its
    component.  Large groups of near copies join their pivot so, and leave the
    pairs of blocks.
    """
    links, least, block = [], sketch_least(percent), block or BLOCK
    for k in range(rounds):
        salted = members.withColumn("turn", F.xxhash64("id", F.lit(k)))
        own = salted.groupBy("cluster").agg(F.count("*").alias("m"), F.min(F.struct("turn", "id", "comp", "sketch")).alias("p")).where(F.col("m") > block)
        own = stored(own.select("cluster", "m", F.col("p.id").alias("pivot"), F.col("p.comp").alias("pc"), F.col("p.sketch").alias("ps")), "pivots")
        if not own.limit(1).count():
            break
        sets = members.join(own.select(F.col("pivot").alias("id")), "id").select(F.col("id").alias("pivot"), F.col("members").alias("other"))
        met = join_hot(members, stored(own.join(sets, "pivot"), "pivots"), "cluster", "m", most=PIVOTS).where("comp <> pc")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                u, v = (np.frombuffer(b"".join(x.column(k).to_pylist()), np.uint8).reshape(x.num_rows, -1) for k in (2, 3))
                x = x.filter(pa.array((u == v).mean(1) >= least))
                ok = [meets(s.values.to_numpy(), t.values.to_numpy(), percent) for s, t in zip(x.column(4), x.column(5), strict=True)]
                yield x.select([0, 1]).filter(pa.array(ok, pa.bool_()))

        found = stored(met.select(F.col("id").alias("a"), F.col("pivot").alias("b"), "sketch", "ps", "members", "other").mapInArrow(run, "a long, b long"), "links")
        if not found.limit(1).count():
            continue
        links.append(found)
        # components of the cluster's components: what met the pivot takes the smallest of their labels
        named = members.select(F.col("id"), "comp")
        ends = found.join(named.withColumnsRenamed({"id": "a", "comp": "x"}), "a").join(named.withColumnsRenamed({"id": "b", "comp": "y"}), "b")
        comp = stored(components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()), "component").select(F.col("id").alias("comp"), "component")
        members = stored(members.join(small_side(comp), "comp", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component"), "peeled")
        # a cluster that is one component now is settled
        open_ = members.groupBy("cluster").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("cluster")
        members = stored(members.join(small_side(open_), "cluster", "left_semi"), "peeled")
    return links, members


def paired_blocks(members: DataFrame) -> DataFrame:
    """A row of members (as for `across`) for each pair of blocks (i, j) that it is in, with its own block.

    Blocks have about BLOCK rows.  Components of more than half a block have
    blocks of their own, and blocks of one component are not paired: a cluster of
    one large component and few other rows costs no more than those rows against it.
    """
    comps = stored(members.groupBy("cluster", "comp").agg(F.count("*").alias("n")), "comps")
    large = F.col("n") > BLOCK // 2
    rest = comps.groupBy("cluster").agg(F.sum("n").alias("m"), F.coalesce(F.sum(F.when(~large, F.col("n"))), F.lit(0)).alias("small"))
    # a component's blocks: its own ones, or one among those of all small components
    blocks = comps.join(rest.select("cluster", "small"), "cluster").select(
        "cluster", F.when(large, F.col("comp")).alias("g"), F.explode(F.sequence(F.lit(0), F.ceil(F.when(large, F.col("n")).otherwise(F.col("small")) / BLOCK).cast("int") - 1)).alias("h")
    )
    label = lambda g, h: F.xxhash64(F.coalesce(g.cast("string"), F.lit("small")), h)
    listed = blocks.distinct().groupBy("cluster").agg(F.collect_list(F.struct(label(F.col("g"), F.col("h")).alias("own"), "g")).alias("blocks"))
    listed = stored(rest.join(listed, "cluster"), "blocks")
    sized = stored(comps.where(large).select("cluster", F.col("comp"), F.col("n").alias("own_n"), "n"), "large")
    # a large component is found by (cluster, comp) in one value, so that a hot one is met without moving its rows
    both = lambda df: df.withColumn("__at", F.xxhash64("cluster", "comp"))
    dealt = join_hot(both(members), both(sized).select("__at", "own_n", "n"), "__at", "n", "left").drop("__at")
    dealt = join_hot(dealt, listed, "cluster", "m")
    g = F.when(F.col("own_n").isNotNull(), F.col("comp"))
    h = F.when(g.isNotNull(), F.pmod(F.xxhash64("id"), F.ceil(F.col("own_n") / BLOCK))).otherwise(F.pmod(F.xxhash64("comp"), F.ceil(F.col("small") / BLOCK)))
    dealt = dealt.withColumn("g", g).withColumn("own", label(F.col("g"), h.cast("int")))
    others = F.filter("blocks", lambda x: F.col("g").isNull() | ~x["g"].eqNullSafe(F.col("g")))
    dealt = dealt.withColumn("other", F.explode(F.transform(others, lambda x: x["own"])))
    return dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "comp", "sketch", "members")


def across(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that join the components of a cluster; members: cluster, id, comp, sketch, members (the full set).

    A task sees two blocks at a time, and gives no more links than it takes to
    join what is in them.  Pairs of blocks are dealt over tasks one by one, also
    those of one cluster.
    """
    least = sketch_least(percent)
    both = paired_blocks(members)

    def run(key: tuple, part: pa.Table) -> pa.Table:
        ids, comp, own = (part.column(c).to_numpy() for c in ("id", "comp", "own"))
        sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        sets = [x.values.to_numpy() for x in part.column("members")]
        found = links_between(np.flatnonzero(own == key[1].as_py()), np.flatnonzero(own == key[2].as_py()), comp, sketch, sets, least, percent)
        return pa.table({"a": pa.array([ids[r] for r, _ in found], pa.int64()), "b": pa.array([ids[k] for _, k in found], pa.int64())})

    return both.repartition("cluster", "i", "j").groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def _labelled(nodes: DataFrame, comp: DataFrame | None) -> DataFrame:
    """nodes (id, ...) with column comp: the component, or the id itself."""
    if comp is None:
        return nodes.withColumn("comp", F.col("id"))
    return nodes.join(comp.withColumnRenamed("component", "c"), "id", "left").withColumn("comp", F.coalesce("c", "id")).drop("c")


def link(docs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Verified links (a, b) that connect what is linked; reps: id, sketch, bands."""
    thrown = reps.select("id", F.explode("bands").alias("key"))
    # a key permutes the ids of its bucket by exclusive or, so that buckets differ in their pivots
    turned = F.col("id").bitwiseXOR(F.shiftrightunsigned("key", 1))
    shared = thrown.groupBy("key").agg(F.min(turned).alias("v"), F.count("*").alias("m")).where("m > 1")
    shared = stored(shared.select("key", F.col("v").bitwiseXOR(F.shiftrightunsigned("key", 1)).alias("pivot"), "m"), "buckets")
    met = stored(thrown.join(small_side(shared), "key"), "members")
    pairs = stored(met.where("id <> pivot").groupBy(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"), F.col("id")).agg(F.count("*").alias("bands")), "pairs")
    # one pivot a document first: the one that it meets in most buckets
    first = stored(pairs.groupBy("id").agg(F.max(F.struct("bands", "a", "b")).alias("x")).select("x.a", "x.b").distinct(), "first")
    links = stored(verified(docs, first, percent), "links")
    comp = stored(components(links), "component")
    # then every other pivot of another component that the sketches do not rule out
    rest = pairs.select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    rest = _labelled(rest.withColumnRenamed("a", "id"), comp).withColumnsRenamed({"id": "a", "comp": "ca"})
    rest = _labelled(rest.withColumnRenamed("b", "id"), comp).withColumnsRenamed({"id": "b", "comp": "cb"}).where("ca <> cb")
    rest = stored(_similar(rest.select("a", "b"), reps, sketch_least(percent)), "rest")
    more = stored(verified(docs, rest, percent), "links")
    links = links.union(more)
    comp = stored(components(links), "component")
    # what remains: buckets of three or more with several components
    own = _labelled(met.where("m > 2").select("id", "key", "pivot"), comp)
    ends = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    left = stored(own.join(small_side(ends), "key", "left_semi").select("id", "pivot").distinct(), "open")
    # one cluster for what meets in such buckets, so that no pair is seen in every band
    cluster = stored(components(left.select(F.col("id").alias("a"), F.col("pivot").alias("b"))), "cluster")
    part = _labelled(cluster.select("id", F.col("component").alias("cluster")), comp).join(reps.select("id", "sketch"), "id")
    early, part = peeled(stored(part.join(sets_of(docs, cluster), "id"), "open"), percent)
    for more in [*early, stored(across(part, percent), "links")]:
        links = links.union(more)
    return links


def _similar(pairs: DataFrame, reps: DataFrame, least: float = SKETCH_LEAST) -> DataFrame:
    """The pairs (a, b) whose sketches agree on `least` or more."""
    sk = reps.select("id", "sketch")
    both = join_split(pairs, sk.select(F.col("id").alias("a"), F.col("sketch").alias("s")), "a", "b", held_by(pairs, "a"))
    both = join_split(both, sk.select(F.col("id").alias("b"), F.col("sketch").alias("t")), "b", "a", held_by(pairs, "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            u, v = (np.frombuffer(b"".join(x.column(k).to_pylist()), np.uint8).reshape(x.num_rows, -1) for k in (2, 3))
            yield x.select([0, 1]).filter(pa.array((u == v).mean(1) >= least))

    return both.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    signed = stored(signatures(docs, banding(percent)[0]), "signed")
    known = signed.where("sig is not null and doc_id is not null")
    rep = stored(known.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).where("m > 1"), "copies")
    owned = join_hot(known.select("doc_id", "sig"), rep, "sig", "m", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    owned = stored(owned, "owned")
    reps = known.withColumnRenamed("doc_id", "id").join(owned.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id", "sig"]).select("id", "sketch", "bands")
    links = link(docs, stored(reps, "reps"), percent)
    edges = links.select("a", "b").union(owned.where("doc_id <> rep").select(F.col("rep"), F.col("doc_id")))
    comp = components(edges)
    out = signed.select("doc_id", "n_shingles").join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
