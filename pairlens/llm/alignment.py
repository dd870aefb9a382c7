"""Alignment of two tokenizers by arrays that say which token owns a byte.

Both tokenizers read a space and the text.  np.repeat gives every byte the index
of its token, once for each tokenizer; places where the pair of owners changes are
the links, places where both change at once are the cuts between groups.

A space behind a character that is no white space ends a token of both kinds (no
piece of either vocabulary has a space inside), so texts are cut there and every
distinct part of a batch is encoded and aligned once; a document is the sequence
of its parts.  A vocabulary without that property takes whole texts as parts.

Each document is encoded once: its counts, its digest and its distinct id pairs
are stored.  How many documents hold a pair is a grouped count of those; counts go
back to the documents by a broadcast of the pairs that are frequent, and by a
shuffled join for the others.

Defined cases: a null or empty text, and one whose joined token bytes are not a
space and the text, has no tokens: zeros and an empty digest; every row is a
document of its own, repeated and null ids included; an empty table gives an empty
result; extra columns are not read.  Memory follows the longest run of text
between two cuts and a batch of about BATCH bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.bpe import encoder, load_ranks
from pairlens.llm.common import BROADCAST_ROWS, join_hot, stored, text_runs

#: Bytes of text that are aligned at once.
BATCH = 4_000_000
#: An id pair is one number: the first id above so many bits, the second below.
BITS = 20
SPACE = "▁"


class Bytes(NamedTuple):
    """The bytes of all tokens of a vocabulary, one behind the other."""

    size: np.ndarray
    at: np.ndarray
    flat: np.ndarray


def token_bytes(tokens: list[bytes]) -> Bytes:
    size = np.array([len(x) for x in tokens], np.int64)
    return Bytes(size, np.cumsum(size) - size, np.frombuffer(b"".join(tokens), np.uint8))


def ragged(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices at, at + 1, ... of every slice, one slice behind the other."""
    return np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Tokenizers:
    """A byte-level vocabulary (A) and a piece model (B) that puts a space before its text."""

    def __init__(self, a_path: str, b_path: str):
        self.path, ranks = a_path, load_ranks(a_path)
        self.first = tiktoken.Encoding(a_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=b_path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            tokens[k] = token
        self.a = token_bytes(tokens)
        pieces = [self.second.id_to_piece(k) for k in range(self.second.get_piece_size())]
        self.b = token_bytes([bytes([int(p[3:5], 16)]) if self.second.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)])
        self.space = self.second.piece_to_id(SPACE)
        probe = self.b.flat[ragged(self.b.at[ids := np.array(self.second.encode(" a  b "))], self.b.size[ids])].tobytes()
        self.cuts = probe == b"  a  b " and not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def _ids_a(self, text: bytes) -> np.ndarray:
        try:
            return self.first.encode_to_numpy(text.decode(), disallowed_special=()).astype(np.int64)
        except ValueError:  # the pattern gives up on runs of a million signs
            return np.frombuffer(encoder(self.path).encode_batch([text.decode()])[0], "<u4").astype(np.int64)

    def encode_a(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts and how many each has; parts go through the library together where a cut lies between them."""
        data, ends = b"".join(parts), np.cumsum([len(x) for x in parts])
        apart = np.setdiff1d(ends, cut_places(np.frombuffer(data, np.uint8))).tolist()
        ids = np.concatenate([np.zeros(0, np.int64), *[self._ids_a(data[i:j]) for i, j in zip([0, *apart[:-1]], apart, strict=True)]])
        return ids, np.diff(np.searchsorted(np.cumsum(self.a.size[ids]), ends, "right"), prepend=0)

    def encode_b(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts and how many each has; the model itself puts the leading space there."""
        found = [ids or [self.space] for ids in self.second.encode([t[1:] for t in parts], num_threads=1)]
        return np.fromiter(chain.from_iterable(found), np.int64), np.array([len(x) for x in found], np.int64)


@lru_cache(2)
def tokenizers_of(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Spaces behind a character that surely is no white space: ASCII signs, and letters of two or three bytes outside the ranges with spaces."""
    at = np.flatnonzero(data == 32)
    at = at[at > 2]
    one, two, three = data[at - 1], data[at - 2], data[at - 3]
    ascii_sign = (one > 32) & (one < 127)
    pair = (one >= 0x80) & (two >= 0xC3) & (two <= 0xDF)
    triple = (one >= 0x80) & (two >= 0x80) & (two < 0xC0) & ((three == 0xE0) | ((three >= 0xE4) & (three <= 0xED)))
    return at[ascii_sign | pair | triple]


class Aligned(NamedTuple):
    """Per part: whether the bytes agree, its counts, where its links start, and its groups as text, each with a semicolon."""

    valid: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    link_at: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    groups: list[bytes]


def _printed(ids: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every id in decimal with its sign behind it, as bytes, and where each ends."""
    width = np.searchsorted(10 ** np.arange(1, 10), ids, "right") + 1
    end = np.cumsum(width + 1)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    out[end - 1] = signs
    for k in range(int(width.max(initial=0))):
        has = width > k
        out[end[has] - 2 - k] = 48 + ids[has] // 10**k % 10
    return out, end


def align_parts(data: np.ndarray, size: np.ndarray, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, vocab_a: Bytes, vocab_b: Bytes) -> Aligned:
    """Links and groups of parts of text: their bytes behind each other, the ids of each part behind each other."""
    parts = len(size)
    part_a, part_b = np.repeat(np.arange(parts), n_a), np.repeat(np.arange(parts), n_b)
    same = (np.bincount(part_a, vocab_a.size[a], parts) == size) & (np.bincount(part_b, vocab_b.size[b], parts) == size)
    for ids, part, vocab in ((a, part_a, vocab_a), (b, part_b, vocab_b)):
        kept = ids[same[part]]
        own = vocab.flat[ragged(vocab.at[kept], vocab.size[kept])]
        where = np.repeat(np.flatnonzero(same), size[same])
        wrong = where[own != data[ragged((np.cumsum(size) - size)[same], size[same])]]
        same[wrong] = False
    a, b, n_a, n_b = a[same[part_a]], b[same[part_b]], np.where(same, n_a, 0), np.where(same, n_b, 0)
    size_a, size_b = vocab_a.size[a], vocab_b.size[b]
    owner_a, owner_b = np.repeat(np.arange(len(a), dtype=np.int32), size_a), np.repeat(np.arange(len(b), dtype=np.int32), size_b)
    new_a, new_b = np.diff(owner_a, prepend=-1) != 0, np.diff(owner_b, prepend=-1) != 0
    at = np.flatnonzero(new_a | new_b)
    group_at = np.cumsum(new_a & new_b) - 1
    ends = np.cumsum(np.where(same, size, 0))
    n_links = np.diff(np.searchsorted(at, ends), prepend=0)
    n_groups = np.diff(np.searchsorted(np.flatnonzero(new_a & new_b), ends), prepend=0)

    group_a, group_b = group_at[np.cumsum(size_a) - size_a], group_at[np.cumsum(size_b) - size_b]
    through_a, through_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
    before_b = np.r_[0, through_b[:-1]]
    rank_a, rank_b = np.arange(len(a)), np.arange(len(b))
    ids, signs = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    if len(a):
        place_a, place_b = rank_a + before_b[group_a], rank_b + through_a[group_b]
        ids[place_a], ids[place_b] = a, b
        signs[place_a[rank_a == through_a[group_a] - 1]] = ord("|")
        signs[place_b[rank_b == through_b[group_b] - 1]] = ord(";")
    text, end = _printed(ids, signs)
    last = np.r_[0, end][np.cumsum(n_a + n_b)].tolist()
    raw = text.tobytes()
    groups = [raw[i:j] for i, j in zip([0, *last[:-1]], last, strict=True)]
    return Aligned(same, n_a, n_b, n_groups, n_links, np.cumsum(n_links) - n_links, a[owner_a[at]], b[owner_b[at]], groups)


def align_texts(texts: list[str | None], tok: Tokenizers) -> tuple[dict[str, np.ndarray], list[str], tuple[np.ndarray, ...]]:
    """Counts and digests of texts, and their distinct links: document, ids of A and B, how often."""
    filled = np.array([bool(t) for t in texts], bool)
    raw = [b" " + t.encode() for t in texts if t]
    data = np.frombuffer(b"".join(raw), np.uint8)
    begin = np.cumsum([0, *map(len, raw)])[:-1].astype(np.int64)
    bound = np.union1d(begin, cut_places(data)) if tok.cuts else begin
    doc = np.flatnonzero(filled)[np.searchsorted(begin, bound, "right") - 1] if len(raw) else np.zeros(0, np.int64)
    parts = pa.LargeStringArray.from_buffers(len(bound), pa.py_buffer(np.r_[bound, len(data)].astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
    which, distinct = parts.indices.to_numpy(), parts.dictionary.to_pylist()
    own = [t.encode() for t in distinct]
    x = align_parts(np.frombuffer(b"".join(own), np.uint8), np.array([len(t) for t in own], np.int64), *tok.encode_a(own), *tok.encode_b(distinct), tok.a, tok.b)
    ok = filled.copy()
    ok[doc[~x.valid[which]]] = False
    which, doc = which[ok[doc]], doc[ok[doc]]
    counts = {k: np.bincount(doc, getattr(x, k)[which], len(texts)).astype(np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
    ends = np.searchsorted(doc, np.arange(len(texts)), "right").tolist()
    listed, digests = which.tolist(), [""] * len(texts)
    for k in np.flatnonzero(ok).tolist():
        groups = b"".join([x.groups[p] for p in listed[ends[k - 1] if k else 0 : ends[k]]])
        digests[k] = hashlib.sha256(groups[:-1]).hexdigest()
    pairs, code = np.unique(x.link_a << BITS | x.link_b, return_inverse=True)
    n = x.n_links[which]
    key, times = np.unique(np.repeat(doc, n) * max(len(pairs), 1) + code[ragged(x.link_at[which], n)], return_counts=True)
    pair = pairs[key % len(pairs)] if len(key) else np.zeros(0, np.int64)
    return counts, digests, (key // max(len(pairs), 1), pair >> BITS, pair & ((1 << BITS) - 1), times)


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row a document: counts, digest of its groups, and its distinct links (ids of A and B, how often)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers_of(a_path, b_path)
        for whole in batches:
            for b in text_runs(whole, most=BATCH):
                counts, digests, (doc, *links) = align_texts(b.column(1).to_pylist(), tok)
                at = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32))) for v in links]
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, counts.values()), pa.array(digests, pa.string()), *lists], names=["doc_id", *counts, "groups_sha256", "a", "b", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, docs, best): how many rows hold each pair, and whether no other pair of its first id has more.

    The maxima have a row an id of A, so the vocabulary bounds their broadcast.
    """
    n = stored(links.groupBy("pair").agg(F.count("*").alias("docs")).withColumn("first", F.shiftright("pair", BITS)), "pairs")
    top = n.groupBy("first").agg(F.max("docs").alias("most"))
    return n.join(F.broadcast(top), "first").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, hot: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; the module says how."""
    each = stored(encoded(docs, a_path, b_path).withColumn("__row", F.monotonically_increasing_id()), "aligned")
    links = each.select("__row", F.inline(F.arrays_zip("a", "b", "times")))
    links = links.select("__row", F.shiftleft(F.col("a").cast("long"), BITS).bitwiseOR(F.col("b").cast("long")).alias("pair"), "times")
    counts = stored(pair_counts(links).withColumn("rows", F.col("docs")), "counts")
    sums = join_hot(links, counts, "pair", "rows", most=hot).groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    zero = [F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("n_best", "count_sum")]
    return each.drop("a", "b", "times").join(sums, "__row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
