"""Words of Arrow text columns as numpy arrays: boundaries and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multipliers (5 modulo 8) and their inverses modulo 2**64.
_BASES = {"byte": 0x9E3779B97F4A7C15 & ~7 | 5, "word": 0xC2B2AE3D27D4EB4F & ~7 | 5}
_INVERSE = {k: pow(v, -1, 2**64) for k, v in _BASES.items()}
_POWERS: dict[tuple[str, int], np.ndarray] = {}


def _powers(kind: str, sign: int, n: int) -> np.ndarray:
    have = _POWERS.get((kind, sign))
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base = np.full(size, (_BASES if sign > 0 else _INVERSE)[kind], dtype=np.uint64)
        base[0] = 1
        have = np.multiply.accumulate(base)
        if size <= 1 << 17:  # a worker keeps short tables only; longer ones take milliseconds
            _POWERS[kind, sign] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hash(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, kind: str) -> np.ndarray:
    """Hash of values[start:stop] for each range, independent of where the range lies."""
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _powers(kind, 1, n), out=total[1:])
    return mix((total[stops] - total[starts]) * _powers(kind, -1, n + 1)[starts] + (stops - starts).astype(np.uint64))


class Words:
    """Words of a run of texts: byte ranges, the text each belongs to, and their hashes."""

    def __init__(self, texts: pa.Array, lower: bool = False, hashes: bool = True):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        buffer = texts.buffers()[2]
        raw = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        data = raw[offsets[0] : offsets[-1]] if len(texts) else raw[:0]
        self.offsets = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
        self.data = data
        solid = ~_GAP[data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[self.offsets] = True
        starts = solid.copy()
        starts[1:] &= ~solid[:-1] | cut[1:-1]
        stops = solid
        stops[:-1] &= ~solid[1:] | cut[1:-1]
        self.starts, self.stops = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        #: Index of the first word of each text; one more entry for the end.
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.hashes = range_hash(_BYTES[_LOWER[data] if lower else data], self.starts, self.stops, "byte") if hashes else None

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``width`` words within one text, and the windows' hashes."""
        n = len(self.starts)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[: n - width + 1] == self.text[width - 1 :])
        return at, range_hash(self.hashes, at, at + width, "word")

    def whole(self) -> np.ndarray:
        """Hash of the whole word sequence of every text."""
        return range_hash(self.hashes, self.first[:-1], self.first[1:], "word")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a partition, after which the worker hands what it freed back to the system: Spark
    keeps workers for later stages, and they stand beside the executor's own heap."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:  # glibc only
                trim(0)

    return whole


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most_bytes`` of text each (a longer text is a slice alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def filled(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts, "")
