"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts of a batch are joined into one array of code points and mapped to eleven
classes.  A finite automaton with twelve states reads classes and marks where a
piece begins (before the current or the previous code point).  Its transition
functions compose associatively, so the automaton runs as a scan: every block of
the array is reduced to one function of its entry state, the functions are
scanned, and all blocks are replayed at once from their true entry states.  The
slices between marks go through a cache to pair merging; no regex is involved.

A piece is one match of the pattern that comes with the public byte-level
vocabularies: contractions, letters, numbers or other signs with at most one
space before, and white space, of which the last code point before a word stays
apart.

Defined cases: null texts are empty and have no tokens; strings of special
tokens are ordinary text; repeated rows are encoded each; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of code points.
LETTER, STMD, RV, E, EL, NUMBER, OTHER, QUOTE, SPACE, WHITE, END = range(11)
#: States: before a text, in letters, numbers or signs, white space (one or more; last a space or not),
#: a quote that may open a contraction, its first letter, and behind a contraction.
START, IN_L, IN_N, IN_O, S1, W1, S2, W2, AFTER_Q, AFTER_RV, AFTER_L, CLOSED = range(12)
#: Marks that a transition sets.
HERE, BEFORE = 1, 2
#: White space beyond ASCII that the pattern's \s takes (fixed values of the Unicode standard).
WIDE_WHITE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points that a scan's block holds; texts joined for one scan have about CHUNK.
WIDTH, CHUNK = 128, 1_000_000
#: Code points of a block's tail whose function is tried first.
TAIL = 6
#: Pieces in each of the two generations that a worker remembers.
CACHE = 400_000
#: Bytes up to which pieces are merged side by side, in classes of like length.
WIDTHS = (8, 12, 16, 24, 40, 64)
_SEP = 0x110000
#: Stands for a pair that the vocabulary does not join.
FAR = np.int32(2**31 - 1)


def _enter(c: int) -> int:
    return IN_L if c <= EL else {NUMBER: IN_N, OTHER: IN_O, QUOTE: AFTER_Q, SPACE: S1, WHITE: W1, END: START}[c]


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state and marks."""
    blank, letter = c in (SPACE, WHITE), c <= EL
    if state in (S1, W1, S2, W2):
        if blank:
            return (S2 if c == SPACE else W2), 0
        if c == END:
            return START, HERE
        split = BEFORE if state in (S2, W2) else 0
        if state in (S1, S2):  # the space goes with what follows
            return (IN_O if c == QUOTE else _enter(c)), split
        return _enter(c), split | HERE
    if state == AFTER_Q:
        if c == STMD:
            return CLOSED, 0
        if c in (RV, EL):
            return (AFTER_RV if c == RV else AFTER_L), 0
        if c in (OTHER, QUOTE):
            return IN_O, 0
    if state == AFTER_RV and c == E or state == AFTER_L and c == EL:
        return CLOSED, 0
    if state in (AFTER_RV, AFTER_L):  # no contraction: the letter began a piece
        return _enter(c), BEFORE | (0 if letter else HERE)
    if state == IN_L and letter or state == IN_N and c == NUMBER:
        return state, 0
    if state == IN_O and c in (OTHER, QUOTE):
        return IN_O, 0
    return _enter(c), HERE


def _table() -> np.ndarray:
    """Row a class, column a state: the next state, and the marks four bits up."""
    out = np.zeros((11, 12), np.uint8)
    for c in range(11):
        for state in range(12):
            nxt, marks = _step(state, c)
            out[c, state] = nxt | marks << 4
    return out


_TABLE = _table()
_NEXT, _BOTH = (_TABLE & 15).copy(), _TABLE.ravel()


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point, by general category; entry _SEP is END."""
    table = np.full(_SEP + 1, OTHER, np.uint8)
    for k in range(_SEP):
        kind = unicodedata.category(chr(k))[0]
        if kind in "LN":
            table[k] = LETTER if kind == "L" else NUMBER
    table[[*range(9, 14), *WIDE_WHITE]] = WHITE
    table[32] = SPACE
    table[ord("'")] = QUOTE
    table[[ord(c) for c in "stmd"]] = STMD
    table[[ord("r"), ord("v")]] = RV
    table[ord("e")], table[ord("l")] = E, EL
    table[_SEP] = END
    return table


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Functions over states, a row each: apply `first`, then `then`."""
    return np.take_along_axis(then, first.astype(np.intp), 1)


def functions_of(columns: np.ndarray) -> np.ndarray:
    """The transition function of each block; columns: classes, a row a place, a column a block.

    Few code points decide where the automaton is, so the function of a block's
    tail is mostly constant and then equals that of the whole block; the others
    are composed in full.
    """
    width, blocks = columns.shape

    def reduced(which: np.ndarray, since: int) -> np.ndarray:
        out = np.broadcast_to(np.arange(12, dtype=np.uint8), (len(which), 12))
        for k in range(since, width):
            out = compose(out, _NEXT[columns[k, which]])
        return out

    out = reduced(np.arange(blocks), max(0, width - TAIL)).copy()
    if width > TAIL and len(more := np.flatnonzero((out != out[:, :1]).any(1))):
        out[more] = reduced(more, 0)
    return out


def entry_states(functions: np.ndarray) -> np.ndarray:
    """State before each function when the first starts in START: a doubling scan over compositions."""
    n = len(functions)
    scan, gap = functions.copy(), 1
    while gap < n:
        scan[gap:] = compose(scan[:-gap], scan[gap:])
        gap *= 2
    out = np.zeros(n, np.uint8)
    out[1:] = scan[:-1, START]
    return out


def starts_of(classes: np.ndarray) -> np.ndarray:
    """Where a piece or an END begins, ascending; the array must end with END."""
    n = len(classes)
    rows = -(-n // WIDTH)
    grid = np.full(rows * WIDTH, END, np.uint8)
    grid[:n] = classes
    columns = np.ascontiguousarray(grid.reshape(rows, WIDTH).T)
    now = entry_states(functions_of(columns)).astype(np.intp)
    marks = np.empty((WIDTH, rows), np.uint8)
    base = columns.astype(np.intp) * 12
    for k in range(WIDTH):
        got = _BOTH[base[k] + now]
        marks[k] = got >> 4
        now = (got & 15).astype(np.intp)
    marks = np.ascontiguousarray(marks.T).ravel()[:n]
    begin = (marks & HERE).astype(bool)
    begin[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return np.flatnonzero(begin)


def split_batch(texts: list[str]) -> list[list[str]]:
    """The pieces of each text."""
    if not texts:
        return []
    points = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts]
    sep = np.array([_SEP], np.uint32)
    joined = np.concatenate([x for p in points for x in (p, sep)])
    starts = starts_of(class_table()[joined])
    ends_at = np.flatnonzero(joined[starts] == _SEP)
    big = "\0".join(texts) + "\0"
    cut = starts.tolist()
    out, k = [], 0
    for stop in ends_at.tolist():
        out.append([big[a:b] for a, b in zip(cut[k:stop], cut[k + 1 : stop + 1], strict=True)])
        k = stop + 1
    return out


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, from a .tiktoken file of ranks or the vocabulary of a .json tokenizer."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # printable stand-ins of bytes in such vocabularies: bytes without one are moved up from U+0100 in order
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    special = {t["content"] for t in found.get("added_tokens", [])}
    return {bytes(back[c] for c in k): v for k, v in found["model"]["vocab"].items() if k not in special}


class Encoder:
    """Pair merging by ascending rank, remembered for each piece."""

    def __init__(self, path: str, most: int = CACHE):
        self.most = most
        self.ranks = load_ranks(path)
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self._index_pairs()

    def _index_pairs(self) -> None:
        """An open-addressed table from pairs of ids to the id of their union, and one for pairs of bytes."""
        pairs = []
        for token, k in self.ranks.items():
            pairs += [(a, b, k) for cut in range(1, len(token)) if (a := self.ranks.get(token[:cut])) is not None and (b := self.ranks.get(token[cut:])) is not None]
        found = np.array(sorted(pairs, key=lambda p: p[2]), np.int64).reshape(-1, 3)
        keys = found[:, 0] << 32 | found[:, 1]
        self.shift = 64 - max(10, int(np.ceil(np.log2(len(keys) + 1))) + 4)
        size = 1 << (64 - self.shift)
        self.keys, self.unions = np.full(size + 64, -1, np.int64), np.full(size + 64, FAR, np.int32)
        left, self.probes = np.arange(len(keys)), 0
        at = self._home(keys)
        while len(left):  # every round places the first comer of each free slot
            free = self.keys[at[left]] < 0
            _, first = np.unique(np.where(free, at[left], -1 - left), return_index=True)
            placed = first[free[first]]
            self.keys[at[left[placed]]], self.unions[at[left[placed]]] = keys[left[placed]], found[left[placed], 2]
            left = np.delete(left, placed)
            at[left] += 1
            self.probes += 1
        a, b = np.divmod(np.arange(1 << 16), 256)
        self.byte_pairs = self.union_of(self.byte_ids[a], self.byte_ids[b])

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.intp)

    def union_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the joined pair for each row, FAR where the vocabulary has none."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = self._home(keys)
        out = np.where(self.keys[at] == keys, self.unions[at], FAR)
        for _ in range(1, self.probes):
            at = at + 1
            out = np.minimum(out, np.where(self.keys[at] == keys, self.unions[at], FAR))
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces: in every round each piece joins its first pair of lowest rank."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 0
        for width in WIDTHS:
            which = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for start in range(0, len(which), 4096):
                rows = which[start : start + 4096]
                if len(rows):
                    for r, x in zip(rows.tolist(), self._merge_block([pieces[r] for r in rows], sizes[rows], width), strict=True):
                        out[r] = x
        for r in np.flatnonzero(sizes > low):
            out[r] = np.array(self._merge_long(pieces[r]), "<u4").tobytes()
        return out

    def _merge_block(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids, size, where = self.byte_ids[raw], sizes.copy(), np.arange(len(pieces))
        done, left = np.zeros((len(pieces), width), "<u4"), sizes.copy()
        joint = self.byte_pairs[raw[:, :-1].astype(np.intp) * 256 + raw[:, 1:]]
        joint = np.where(np.arange(width - 1) < (size - 1)[:, None], joint, FAR)
        place = np.arange(width)
        while True:
            k = joint.argmin(1)
            best = joint[np.arange(len(k)), k]
            over = best == FAR
            if over.any():
                done[where[over]], left[where[over]] = ids[over], size[over]
                go = ~over
                ids, joint, size, where, k, best = ids[go], joint[go], size[go], where[go], k[go], best[go]
                if not len(k):
                    flat = done[place < left[:, None]].tobytes()
                    ends = (4 * np.cumsum(left)).tolist()
                    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            line = np.arange(len(k))
            take = np.minimum(place + (place > k[:, None]), width - 1)
            ids = np.take_along_axis(ids, take, 1)
            ids[line, k] = best
            joint = np.take_along_axis(joint, np.minimum(take[:, :-1], width - 2), 1)
            size = size - 1
            joint[line, np.minimum(size - 1, width - 2)] = FAR
            has = np.flatnonzero(k > 0)
            joint[has, k[has] - 1] = self.union_of(ids[has, k[has] - 1], ids[has, k[has]])
            has = np.flatnonzero(k < size - 1)
            joint[has, k[has]] = self.union_of(ids[has, k[has]], ids[has, k[has] + 1])

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same with a heap and links, in n log n steps."""
        n, get = len(raw), self.ranks.get
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := get(raw[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, stop = heapq.heappop(heap)
            if not alive[k] or end[k] >= n or end[end[k]] != stop or not alive[end[k]]:
                continue
            gone = end[k]
            alive[gone], end[k] = False, stop
            if stop < n:
                before[stop] = k
                if (r := get(raw[k : end[stop]])) is not None:
                    heapq.heappush(heap, (r, k, end[stop]))
            if (p := before[k]) >= 0 and (r := get(raw[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [self.ranks[raw[k : end[k]]] for k in range(n) if alive[k]]

    def learn(self, need: set[str]) -> None:
        """Put pieces that the young generation lacks into it; a full one becomes the old one first."""
        if len(self.cache) >= self.most:
            self.old, self.cache = self.cache, {}
        need = need.difference(self.cache)
        if known := [p for p in need if p in self.old]:
            self.cache.update(zip(known, map(self.old.__getitem__, known), strict=True))
            need.difference_update(known)
        new = list(need)
        self.cache.update(zip(new, self.merge_many([p.encode() for p in new]), strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = split_batch(texts)
        seen = set().union(*split)
        self.learn(seen)
        out = [b"".join(map(self.cache.__getitem__, pieces)) for pieces in split]
        for p in seen:
            if len(p) > 64:
                del self.cache[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset of every token in the decoded text, and its length at the end."""
        sizes = [len(self.tokens[k]) for k in np.frombuffer(ids, "<u4").tolist()]
        return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def chunks(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) in runs of about `most` code points; nulls are empty."""
    first, run, size = 0, [], 0
    for k, t in enumerate(texts):
        run.append(t or "")
        size += len(run[-1])
        if size >= most:
            yield first, run
            first, run, size = k + 1, [], 0
    if run:
        yield first, run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the byte offset of each token, for columns doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for first, part in chunks(texts):
                found = enc.encode_batch(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(part)),
                        pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in found], pa.list_(pa.int32())),
                        pa.array([enc.offsets(x)[:-1] for x in found], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "ids", "offsets"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, offsets array<long>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 digests of the ids and of the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for first, part in chunks(texts):
                found = enc.encode_batch(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(part)),
                        pa.array([len(x) // 4 for x in found], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in found]),
                        pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in found]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
