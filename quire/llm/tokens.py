"""Vectorised words and shingles over Arrow string columns.

A word is a run of bytes other than space and U+0009-U+000D; A-Z may be folded to a-z. Every word gets a
64-bit hash computed from prefix sums over the raw UTF-8 bytes, so that no Python object is made per word.
Batches are cut into pieces of a few megabytes: memory is bounded by the piece, or by one text where a
single text is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_rng = np.random.default_rng(20240)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_LANES = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + (PIECE >> 2))
        inverse = pow(_BASE, -1, 2**64)
        with np.errstate(over="ignore"):
            tables = []
            for base in (_BASE, inverse):
                steps = np.full(size, np.uint64(base))
                steps[0] = 1
                tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


@dataclass
class Piece:
    """Rows ``first`` to ``first + rows`` of a batch; ``offsets`` are byte positions in ``data``."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[Piece]:
    """The texts of a string column, null as empty, in pieces of about ``size`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, n)
        yield Piece(at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """Words of a piece in order: row (within the piece), byte start and end, hash."""

    rows: int
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each row, and the end: index of its first word


def words(piece: Piece, lower: bool = True, keep: np.ndarray | None = None) -> Words:
    """``keep``: a table of 256 flags, which bytes are part of words (default: all but white space)."""
    data = piece.data
    inside = (~_SPACE if keep is None else keep)[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[piece.offsets] = True
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside
    start = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    row = np.searchsorted(piece.offsets, start, "right") - 1
    return Words(piece.rows, row, start, end, spans_hash(data, start, end, lower), np.searchsorted(start, piece.offsets))


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((_BYTE[_LOWER] if lower else _BYTE)[data] * power[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def spans_sum(value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A sum of each span's hashes that depends on their order, from prefix sums."""
    power, inverse = _power_tables(len(value) + 1)
    sums = np.zeros(len(value) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(value * power[: len(value)], out=sums[1:])
        return (sums[end] - sums[start]) * inverse[start]


def shingles(w: Words, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and hash of each run of ``k`` words; with ``whole``, a row with fewer words has one of them all."""
    n = len(w.hash)
    at = np.zeros(0, np.int64)
    out = np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if n >= k:
            total = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                total += w.hash[j : n - k + 1 + j] * _LANES[j]
            good = w.row[: n - k + 1] == w.row[k - 1 :]
            at = np.flatnonzero(good)
            out = mix(total[good])
        row = w.row[at]
        if whole:
            count = np.diff(w.first)
            few = np.flatnonzero((count > 0) & (count < k))
            if len(few):
                begin = w.first[few]
                longest = int(count[few].max())
                total = count[few].astype(np.uint64)
                for j in range(longest):
                    has = count[few] > j
                    total[has] += w.hash[begin[has] + j] * _LANES[j]
                row, at, out = np.concatenate([row, few]), np.concatenate([at, begin]), np.concatenate([out, mix(total)])
    return row, at, out


def distinct_sets(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order: row, value, and the offsets of the rows."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if len(row):
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[new], value[new]
    return row, value, np.searchsorted(row, np.arange(rows + 1))
