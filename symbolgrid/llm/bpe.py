"""Byte-level BPE with a segment tree over byte positions.

A piece of n bytes starts as n tokens. Leaf i of the tree holds ``rank * size + i`` for the pair
of the live token that starts at byte i and its live right neighbour (nothing, if the two do not
merge), so the root is the leftmost pair of minimum rank. A merge takes the right neighbour out
and changes three leaves (the merged token, its left neighbour, the token taken out), each with a
walk of log2(n) steps to the root. Encoding a piece is O(n log n), whatever its length.

Short pieces that a batch has not met yet go through the same tree together, one array row each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolgrid.llm.words import filled, pieces, tidy

#: Pieces whose ids a worker remembers, about 250 bytes each; beyond it only those of the
#: present batch stay (results do not depend on it).
REMEMBERED = 150_000
#: Pieces of at most so many bytes are merged in rows of an array; longer ones one by one.
SHORT = 64
_NONE = 1 << 62


def parse_ranks(lines: list[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_order(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece by leftmost minimum-rank merges."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 1).bit_length()
    shift = size.bit_length()
    get = ranks.get
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << shift | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    stop = list(range(1, n + 1))  # end of the live token that starts here
    left = list(range(-1, n))  # start of the live token before it; left[n] is that of the last
    mask = (1 << shift) - 1

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            k >>= 1
            low = value if value < other else other
            if tree[k] == low:
                return
            tree[k] = value = low

    while tree[1] != _NONE:
        i = tree[1] & mask
        j = stop[i]
        end = stop[j]
        put(j, _NONE)
        stop[i], left[end] = end, i
        rank = get(piece[i : stop[end]]) if end < n else None
        put(i, _NONE if rank is None else rank << shift | i)
        before = left[i]
        if before >= 0:
            rank = get(piece[before:end])
            put(before, _NONE if rank is None else rank << shift | before)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : stop[i]]])
        i = stop[i]
    return out


class PairRanks:
    """Ranks of pairs of tokens by binary search: every split of a token into two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, found = [], []
        for raw, rank in ranks.items():
            for cut in range(1, len(raw)):
                a, b = ranks.get(raw[:cut]), ranks.get(raw[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    found.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array(found, dtype=np.int64)[order], 0)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the two do not merge."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def merge_rows(rows: list[bytes], pair_rank: PairRanks, byte_ids: np.ndarray) -> list[bytes]:
    """Ids of many pieces of 2 to SHORT bytes, as little-endian 32-bit integers: one segment tree a row."""
    out: list[bytes] = [b""] * len(rows)
    lengths = np.array([len(r) for r in rows])
    sizes = 1 << np.ceil(np.log2(lengths)).astype(np.int64)
    for size in np.unique(sizes).tolist():
        pick = np.flatnonzero(sizes == size)
        n, m = lengths[pick], len(pick)
        shift = size.bit_length()
        raw = np.frombuffer(b"".join(rows[k].ljust(size, b"\0") for k in pick.tolist()), dtype=np.uint8).reshape(m, size)
        token = byte_ids[raw]
        live = np.arange(size) < n[:, None]
        following = np.tile(np.arange(1, size + 1), (m, 1))
        before = np.tile(np.arange(-1, size), (m, 1))
        tree = np.full((m, 2 * size), _NONE, dtype=np.int64)
        first = pair_rank(token[:, :-1], token[:, 1:])
        tree[:, size:-1] = np.where((first >= 0) & live[:, 1:], first << shift | np.arange(size - 1), _NONE)
        for level in range(size.bit_length() - 2, -1, -1):
            at = 1 << level
            tree[:, at : 2 * at] = np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2])

        def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray, tree=tree, size=size) -> None:
            at = size + leaf
            tree[row, at] = value
            while at[0] > 1:
                at = at >> 1
                tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])

        row = np.flatnonzero(tree[:, 1] != _NONE)
        while len(row):
            low = tree[row, 1]
            i = low & ((1 << shift) - 1)
            j = following[row, i]
            end = following[row, j]
            merged = low >> shift
            token[row, i] = merged
            live[row, j] = False
            following[row, i] = end
            before[row, end] = i
            put(row, j, np.full(len(row), _NONE))
            inside = end < n[row]
            rank = pair_rank(merged, token[row, np.minimum(end, size - 1)])
            put(row, i, np.where(inside & (rank >= 0), rank << shift | i, _NONE))
            left = before[row, i]
            some = np.flatnonzero(left >= 0)
            if len(some):
                at, left = row[some], left[some]
                rank = pair_rank(token[at, left], merged[some])
                put(at, left, np.where(rank >= 0, rank << shift | left, _NONE))
            row = row[tree[row, 1] != _NONE]
        ids = token[live].astype("<u4").tobytes()
        stops = (4 * np.cumsum(live.sum(axis=1))).tolist()
        start = 0
        for k, stop in zip(pick.tolist(), stops, strict=True):
            out[k] = ids[start:stop]
            start = stop
    return out


class Codec:
    """Encoder and decoder for one rank file; every single byte must have a rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.memory = ranks, {}
        self.find = regex.compile(pattern).findall
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for raw, i in ranks.items():
            self.bytes[i] = raw
        self.pair_rank = PairRanks(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)

    def _learn(self, found: set[str]) -> None:
        unseen = found - self.memory.keys()
        if len(self.memory) + len(unseen) > REMEMBERED:
            self.memory = {piece: self.memory[piece] for piece in found - unseen}
        rows: list[tuple[str, bytes]] = []
        for piece in unseen:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.memory[piece] = whole.to_bytes(4, "little")
            elif len(raw) <= SHORT:
                rows.append((piece, raw))
            else:
                self.memory[piece] = np.array(merge_order(raw, self.ranks), dtype="<u4").tobytes()
        if rows:
            self.memory.update(zip((p for p, _ in rows), merge_rows([r for _, r in rows], self.pair_rank, self.byte_ids), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as little-endian 32-bit integers."""
        lists = [self.find(t) for t in texts]
        self._learn(set().union(*lists))
        ids = self.memory.__getitem__
        return [b"".join(map(ids, x)) for x in lists]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@cache
def _codec(lines: tuple[bytes, ...], pattern: str) -> Codec:
    return Codec(parse_ranks(list(lines)), pattern)


def load_codec(spark, rank_file: str, pattern: str):
    """A broadcast of the rank file's lines (about a megabyte, fixed) and the pattern."""
    with open(rank_file, "rb") as f:
        return spark.sparkContext.broadcast((tuple(f.read().splitlines()), pattern))


def encode_column(docs: DataFrame, codec, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian uint32; only if asked for), ids_sha256, decoded_sha256.

    One row per input row, other columns ignored. Null and empty texts have no tokens; a null
    doc_id stays null. The decoded bytes are those of the text (null: none). Repeated rows are
    encoded alike, texts of any length whole; an empty table gives no rows.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _codec(*codec.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                codes = c.encode(filled(part.column("text")).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(x) // 4 for x in codes], pa.int64()),
                        pa.array(codes if ids else [None] * len(codes), pa.binary()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in codes], pa.string()),
                        pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in codes], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
