"""Vectorised hashing of the words of whole texts, shared by the operators on documents.

A word is a maximal run of bytes other than space and \\t..\\r; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)
#: Bytes of text worked on at once; a longer text is one slice by itself.
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """*n* fixed odd 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=U) * _MULT + U(seed)) | U(1)


_EXACT = constants(256, 11)
_BYTE = constants(256, 11)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_P = 0xD6E8FEB86659FD93
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for later calls."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=U)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    large = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64), raw[offsets[0] : offsets[-1]] if len(offsets) else raw


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most *most* bytes each, or a single longer row."""
    first = 0
    n = len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_hashes(offsets: np.ndarray, raw: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and where each row's words begin (one more entry than rows); *exact* tells A-Z from a-z."""
    off = offsets - offsets[0]
    raw = raw[offsets[0] : offsets[-1]]
    n = len(raw)
    if not n:
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    solid = ~_SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:]))
    sums = np.cumsum((_EXACT if exact else _BYTE)[raw] * _power(_P, n)[:n], dtype=U)
    left = np.where(starts > 0, sums[starts - 1], U(0))
    words = mix((sums[ends] - left) * _power(_PINV, n)[starts])
    return words, np.searchsorted(starts, off)


def shingle_hashes(words: np.ndarray, at: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, sorted. A row of fewer words has its whole sequence as one shingle."""
    c = constants(width, 29)
    n = len(words)
    runs = np.zeros(max(0, n - width + 1), dtype=U)
    for j in range(width):
        runs += words[j : n - width + 1 + j] * c[j] if n >= width else runs
    runs = mix(runs)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        m = b - a
        if m >= width:
            s = np.sort(runs[a : b - width + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif m:
            yield mix((words[a:b] * c[:m]).sum(dtype=U, keepdims=True) + U(m))
        else:
            yield np.zeros(0, dtype=U)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of every row of a string column, in order."""
    offsets, raw = buffers(column)
    for first, last in slices(offsets):
        words, at = word_hashes(offsets[first : last + 1], raw)
        yield from shingle_hashes(words, at, width)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the consecutive rows that agree in the first *keys* columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        cut = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(cut).tolist(), b.num_rows]
        for x, y in zip(at[:-1], at[1:], strict=True):
            now = tuple(c[x] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, the consecutive rows that agree in the first *keys* columns, and where each begins and the last ends.

    A table is about a batch; a larger group is a table with those before it.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        cut = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        at = int(np.flatnonzero(cut)[-1]) if cut.any() else 0
        if held and (at or first != last):
            yield _with_starts([*held, b.slice(0, at)], keys)
            held = []
        elif at:
            yield _with_starts([b.slice(0, at)], keys)
        held.append(b.slice(at))
        last = tuple(c[-1] for c in cols)
    if held:
        yield _with_starts(held, keys)


def _with_starts(parts: list[pa.RecordBatch], keys: int) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches(parts)
    cut = np.zeros(t.num_rows + 1, dtype=bool)
    cut[[0, -1]] = True
    for i in range(keys):
        c = t.column(i).to_numpy()
        cut[1:-1] |= c[1:] != c[:-1]
    return t, np.flatnonzero(cut)
