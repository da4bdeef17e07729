"""Byte-level kernels over Arrow string batches: chunks of documents, words, polynomial hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text worked on at once; one document is never split.
CHUNK = 1 << 21

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
ODD = _rng.integers(1, 1 << 62, 16, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
#: The inverse of BASE modulo 2^64.
BASE_INV = U(pow(int(BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_LOWER = BYTE[LOWER]
#: A second table, for hashes that have to be told apart by 128 bits.
BYTE_2 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i for i < n at least."""
    size = max(CHUNK, 1 << (n - 1).bit_length()) + 1
    if size not in _powers:
        up, down = np.full(size, BASE), np.full(size, BASE_INV)
        up[0] = down[0] = U(1)
        _powers.clear()
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return to the system what a worker has freed; workers are used again by later steps."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def string_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and its n + 1 offsets into them."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about limit bytes."""
    give_back()
    data, offsets = string_views(column)
    n, lo = len(column), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def sections(column: pa.Array, limit: int, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each piece, its place in its row, bytes, offsets from 0); texts above limit come in several pieces that overlap."""
    for lo, hi, data, offsets in chunks(column, limit):
        if len(data) <= limit + overlap:
            yield np.arange(lo, hi), np.zeros(hi - lo, np.int64), data, offsets
            continue
        for at in range(0, len(data) - overlap, limit):
            part = data[at : at + limit + overlap]
            yield np.array([lo]), np.array([at]), part, np.array([0, len(part)])


def prefix_hash(data: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """n + 1 prefix sums whose differences are polynomial hashes of substrings."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def window_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of size bytes."""
    n = len(prefix) - size
    return (prefix[size:] - prefix[:-size]) * powers(len(prefix))[1][: max(n, 0)] if n > 0 else np.empty(0, np.uint64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (ASCII letters lower-cased), and n + 1 offsets of each document's words among them."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    if n > 2 * CHUNK and len(offsets) == 2:  # one long text: section by section, cut behind white space
        cuts = [0]
        while n - cuts[-1] > CHUNK:
            at = cuts[-1] + CHUNK
            while at < n and not len(space := np.flatnonzero(SPACE[data[at : at + CHUNK]])):
                at += CHUNK
            cuts.append(min(n, at + int(space[0]) + 1) if at < n else n)
        hashes = [words(data[a:b], np.array([0, b - a]))[0] if b - a <= 2 * CHUNK else _words(data[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts, [*cuts[1:], n]) if a < b]
        return np.concatenate(hashes), np.array([0, sum(map(len, hashes))])
    return _words(data, offsets)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    begins[inner] = solid[inner]
    ends = np.zeros(n + 1, bool)
    ends[1:n] = solid[:-1] & ~solid[1:]
    ends[n] = solid[-1]
    inner = offsets[1:][offsets[1:] > 0]
    ends[inner] = solid[inner - 1]
    at, to = np.flatnonzero(begins), np.flatnonzero(ends)
    prefix = prefix_hash(data, BYTE_LOWER)
    h = (prefix[to] - prefix[at]) * powers(n + 1)[1][at]
    return mix(h + (to - at).astype(np.uint64) * ODD[0]), np.searchsorted(at, offsets)


def distinct_runs(word_hash: np.ndarray, starts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and n + 1 offsets; fewer words than size are one shingle."""
    n, docs = len(word_hash), len(starts) - 1
    counts = np.diff(starts)
    keys, owner = [], []
    if n >= size:
        h = word_hash[: n - size + 1] * ODD[1]
        for k in range(1, size):
            h = h + word_hash[k : n - size + 1 + k] * ODD[k + 1]
        doc = np.repeat(np.arange(docs), counts)
        whole = doc[: n - size + 1] == doc[size - 1 :]
        keys.append(mix(h[whole]))
        owner.append(doc[: n - size + 1][whole])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        h = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            there = counts[short] > k
            h[there] += word_hash[starts[short][there] + k] * ODD[k + 1]
        keys.append(mix(h + counts[short].astype(np.uint64) * ODD[9]))
        owner.append(short)
    if not keys:
        return np.empty(0, np.uint64), np.zeros(docs + 1, np.int64)
    key, own = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[new], own[new]
    return key, np.searchsorted(own, np.arange(docs + 1))
