"""Words of whole texts as 64-bit hashes, computed on Arrow buffers without a Python object per word.

A word is a run of bytes other than white space (0x20, 0x09-0x0D); A-Z count as a-z. A null text has no words. Hashes of
different words differ but for a chance near 2^-64. Work goes on in slices of about `SLICE` bytes, so memory follows the
slice, and for a longer text eight bytes per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_BASE = 0x9E6C63D0676A9A99              # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + 1
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (multiply and shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _power_tables(size: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) <= size:
        ones = np.ones(max(size, 2 * SLICE) + 1, dtype=np.uint64)
        for base in (_BASE, _INVERSE):
            steps = ones * np.uint64(base)
            steps[0] = 1
            _powers.append(np.cumprod(steps))
        del _powers[:-2]
    return _powers


def _hash_runs(data: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in `data` and the byte where each begins; no word goes over a text start."""
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[text_starts] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LOWER[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def hash_bytes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text of any length, a slice at a time."""
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and not _SPACE[data[end]]:       # a cut in the middle of a word moves to its end
            ahead = np.flatnonzero(_SPACE[data[end:end + SLICE]])
            end = end + int(ahead[0]) if len(ahead) else min(len(data), end + SLICE)
        found.append(_hash_runs(data[at:end], np.zeros(1, dtype=np.int64))[0])
        at = end
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8), bounds


def word_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, bounds): words of row first+i are hashes[bounds[i]:bounds[i+1]]."""
    data, bounds = text_buffer(column)
    row, n = 0, len(bounds) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + SLICE, side="right")) - 1)
        piece = data[bounds[row]:bounds[end]]
        if end == row + 1 and len(piece) > SLICE:
            hashes = hash_bytes(piece)
            yield row, end, hashes, np.array([0, len(hashes)])
        else:
            offsets = bounds[row:end + 1] - bounds[row]
            hashes, starts = _hash_runs(piece, offsets)
            yield row, end, hashes, np.searchsorted(starts, offsets)
        row = end


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words; entry i is the run that starts at word i. Runs ignore text bounds."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    rolled = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for j in range(n):
        rolled = rolled * _STEP + hashes[j:j + len(rolled)]
    return mix(rolled)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int, whole_if_short: bool = True) -> Iterator[np.ndarray]:
    """Per text its distinct shingle hashes, sorted. A text of fewer words than `width` has its whole sequence as one
    shingle (none with whole_if_short=False); a text without words has none."""
    runs = ngram_hashes(hashes, width)
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if end - start >= width:
            found = np.sort(runs[start:end - width + 1])
            yield found[np.concatenate(([True], found[1:] != found[:-1]))]
        elif end > start and whole_if_short:
            yield ngram_hashes(hashes[start:end], end - start) ^ np.uint64(end - start)
        else:
            yield np.zeros(0, dtype=np.uint64)
