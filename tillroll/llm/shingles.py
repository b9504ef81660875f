"""Word shingles of Arrow batches as 64-bit hashes, computed on the bytes of a whole batch at once.

A word is a run of bytes other than space and U+0009 to U+000D; A-Z count as
a-z.  (Bytes of a longer UTF-8 character are never white space.)  A word's hash
is a difference of prefix sums of ``table[byte] * P**i``, moved to the origin by
the inverse power, so it doesn't depend on where the word stands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_U = np.uint64
#: Odd, so that it has an inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_TABLE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_TABLE[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose result bits depend on all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base), np.uint64)
    if n:
        out[0] = _U(1)
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each row's bytes begin (one more than rows); null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each row's words begin."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = inside[cuts]  # a row's first byte begins a word though the row before ends in one
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[raw] * powers(_P, n), out=sums[1:])
        hashes = mix64((sums[ends] - sums[starts]) * powers(_P_INV, n)[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row: (hashes sorted by row and value, where each row begins, words of each row).

    A row with fewer words than ``width`` has one shingle, all its words; one without words has none.
    """
    raw, offsets = text_bytes(column)
    words, at = word_hashes(raw, offsets)
    counts = np.diff(at)
    rows = len(counts)
    with np.errstate(over="ignore"):
        total = np.zeros(len(words), np.uint64)
        for k in range(min(width, len(words))):
            factor = _U((0xD1B54A32D192ED03 * (2 * k + 1)) & (2**64 - 1))
            total[: len(words) - k] += mix64(words[k:] * factor + _U(k + 1))
        full = mix64(total)
    n_windows = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begins = np.cumsum(n_windows) - n_windows
    index = np.arange(int(n_windows.sum())) + np.repeat(at[:-1] - begins, n_windows)
    values = full[index]
    with np.errstate(over="ignore"):
        for r in np.flatnonzero((counts > 0) & (counts < width)):
            own = words[at[r] : at[r + 1]] * _U(0xA0761D6478BD642F) + np.arange(counts[r], dtype=np.uint64)
            values[begins[r]] = mix64(mix64(own).sum(dtype=np.uint64, keepdims=True) + _U(int(counts[r])))[0]
    keep = np.ones(len(values), bool)
    for b, e in zip(begins.tolist(), (begins + n_windows).tolist()):
        values[b:e].sort()
        keep[b + 1 : e] = values[b + 1 : e] != values[b : e - 1]
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], kept_before[np.append(begins, len(values))], counts


def slices(batch: pa.RecordBatch, text: int, most_bytes: int = 1 << 21, most_rows: int = 2048):
    """Parts of a batch with bounded text, so that a task's arrays stay small; a longer text comes alone."""
    sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and (held + size > most_bytes or i - begin >= most_rows):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(size)
    if begin < len(sizes):
        yield batch.slice(begin)
