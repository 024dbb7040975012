"""Word and shingle hashes of whole Arrow batches with numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D, which in UTF-8
are the same runs as of code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes hashed at once: bounds the temporary arrays to about 8 times this
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]
_FACTOR = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                                  0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done:done + more] = out[:more] * step
        done += more
    return out


_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK, 1 << (max(n, 1) - 1).bit_length()) + 1
    if size not in _POW:
        _POW.clear()
        _POW[size] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _POW[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def _words(data: np.ndarray, cuts: np.ndarray, lower: bool):
    """Start, end and hash of each word of ``data``; a new text begins at each of ``cuts``."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    space = _SPACE[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = space[:-1]
    first[cuts[cuts < n]] = True
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = space[1:]
    last[cuts[(cuts > 0) & (cuts < n)] - 1] = True
    starts = np.flatnonzero(first & ~space)
    ends = np.flatnonzero(last & ~space) + 1
    power, inverse = _tables(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((_LOWER if lower else _BYTE)[data] * power[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return starts, ends, mix(h + (ends - starts).astype(np.uint64) * _FACTOR[4])


def text_runs(column: pa.Array, lower: bool = False):
    """Yield ``(row, bytes, inner, cut, starts, ends, hashes)`` for each run of texts of about ``CHUNK`` bytes.

    Text ``row + k`` has the bytes ``inner[k]`` to ``inner[k + 1]`` and the words ``cut[k]`` to ``cut[k + 1]``;
    starts and ends are byte offsets in the run. Null counts as empty.
    """
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    _, off_buf, data_buf = column.buffers()
    offsets = np.frombuffer(off_buf, np.int32, n + 1 + column.offset)[column.offset:].astype(np.int64)
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        lo, hi = offsets[row], offsets[upto]
        inner = offsets[row:upto + 1] - lo
        starts, ends, hashes = _words(data[lo:hi], inner[:-1], lower)
        yield row, data[lo:hi], inner, np.searchsorted(starts, inner), starts, ends, hashes
        row = upto


def text_words(column: pa.Array, lower: bool = False):
    """Yield ``(row, starts, ends, hashes)`` for each text; null counts as empty.

    Starts and ends are byte offsets in the text. Texts are hashed in runs of about ``CHUNK`` bytes.
    """
    for row, _, inner, cut, starts, ends, hashes in text_runs(column, lower):
        for k in range(len(inner) - 1):
            a, b = cut[k], cut[k + 1]
            yield row + k, starts[a:b] - inner[k], ends[a:b] - inner[k], hashes[a:b]


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; a shorter, non-empty text is one shingle."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total += mix(hashes[k:n - width + 1 + k] * _FACTOR[k % 5] + np.uint64(k))
    return mix(total)
