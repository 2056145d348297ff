"""Word shingles of many texts at once, as 64-bit hashes, with numpy over the flat UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes and the offsets of each; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of all texts."""
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = inside & (first[:-1] | np.concatenate([[True], ~inside[:-1]]))
    finish = inside & (first[1:] | np.concatenate([~inside[1:], [True]]))
    return np.flatnonzero(begin), np.flatnonzero(finish) + 1


def powers(n: int) -> np.ndarray:
    """A factor for each of the first ``n`` places in a word."""
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE, np.uint64)]), dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z in lower case, and the number of words of each text."""
    starts, ends = word_spans(data, offsets)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    lens = ends - starts
    at = np.repeat(starts, lens)
    place = np.arange(len(at)) - np.repeat(np.cumsum(lens) - lens, lens)
    values = BYTE[LOWER[data[at + place]]] * powers(int(lens.max()))[place]
    hashes = mixed(np.add.reduceat(values, np.cumsum(lens) - lens) + lens.astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, offsets))
    return hashes, counts


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. A text of fewer words has its whole sequence as its one shingle."""
    hashes, counts = word_hashes(*flat_bytes(column))
    n = max(0, len(hashes) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += hashes[k : k + n] * _PLACE[k]
    rolled = mixed(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(rolled[at : at + c - width + 1]))
        elif c:
            short = (hashes[at : at + c] * _PLACE[8 : 8 + c]).sum(dtype=np.uint64) + np.uint64(c)
            out.append(mixed(np.array([short], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


class MinHasher:
    """``size`` minima of random affine maps of a shingle set."""

    def __init__(self, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, size, dtype=np.uint64)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of 32-bit minima for each set; sets must not be empty."""
        flat = np.concatenate(sets)
        starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
        out = np.empty((len(sets), len(self.a)), np.uint32)
        for j, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            out[:, j] = np.minimum.reduceat((flat * a + b) >> np.uint64(32), starts)
        return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
