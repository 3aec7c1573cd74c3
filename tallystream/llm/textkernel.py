"""Vectorised text kernels that run inside Spark tasks on Arrow buffers.

A batch's strings lie in one UTF-8 buffer.  The kernels walk that buffer in slices of a bounded
number of bytes, so memory follows the slice (or the longest single text), not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
SLICE_BYTES = 1 << 21

_U = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_ROW = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | _U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below at least n."""
    size = 1 << max(12, int(n - 1).bit_length())
    if size not in _powers:
        both = []
        for base in (_P, _P_INV):
            t = np.full(size, base, _U)
            t[0] = 1
            both.append(np.multiply.accumulate(t))
        _powers.clear()
        _powers[size] = (both[0], both[1])
    return _powers[size]


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts (a null text is empty)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Runs [i, j) of texts with at most so many bytes together, or one longer text."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        out.append((i, j))
        i = j
    return out


def _flat_words(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of buf; a word ends at each of starts, too."""
    n = len(buf)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    word = ~_SEP[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = starts[(starts > 0) & (starts < n)]
    first[cut] = word[cut]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[cut - 1] = word[cut - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _pow_tables(n)
    acc = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[buf] * up[:n], out=acc[1:])
    return mix((acc[e] - acc[s]) * down[s] + (e - s).astype(_U)), s


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` (A-Z lower-cased) of the texts of a slice, and each text's first word.

    A slice is a few whole texts, or one long text, which is cut between words.
    """
    base = int(offsets[0])
    if offsets[-1] - base <= 4 * SLICE_BYTES:
        own = offsets - base
        h, s = _flat_words(buf[base : offsets[-1]], own[:-1])
        return h, np.searchsorted(s, own)
    parts, at, end = [], base, int(offsets[-1])
    while at < end:
        stop = min(end, at + SLICE_BYTES)
        while stop < end and not _SEP[buf[stop]]:
            step = buf[stop : stop + 4096]
            hit = np.flatnonzero(_SEP[step])
            stop = stop + int(hit[0]) if len(hit) else min(end, stop + 4096)
        parts.append(_flat_words(buf[at:stop], np.zeros(1, np.int64))[0])
        at = stop
    h = np.concatenate(parts) if parts else np.zeros(0, _U)
    return h, np.array([0, len(h)])


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `width`-word shingles of one text.

    A text with fewer words has its whole sequence as its one shingle; one without words has none.
    Two shingles share a hash with a chance of 2**-64.
    """
    n = len(words)
    if not n:
        return np.zeros(0, _U)
    k = min(width, n)
    h = np.full(n - k + 1, k, _U)
    for i in range(k):
        h += words[i : n - k + 1 + i] * _ROW[i]
    return np.unique(mix(h))
