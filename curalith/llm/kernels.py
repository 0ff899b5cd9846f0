"""Vectorised text kernels shared by the operators of this subpackage.

Every function works on one Arrow batch inside a Spark task: the texts are viewed as one flat
byte array plus offsets, without a Python object per document or word.  Hashes are 64 bits wide
and depend on content only, so tasks agree on them without talking to each other.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)
#: Bytes handled at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 20


def flat_texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and offsets (n + 1) of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges (first, last + 1) of documents of about ``limit`` bytes together."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(n, U64)
    one[1:] = U64(_B)
    inv = np.ones(n, U64)
    inv[1:] = U64(_B_INV)
    return np.cumprod(one, dtype=U64), np.cumprod(inv, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    return _powers(size)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each span, from prefix sums of a polynomial modulo 2**64."""
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space), and each one's document."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; other bytes, those of other letters included, stay."""
    return _LOWER[data]


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles and their documents, in order; a document with fewer
    words has its whole sequence as its one shingle, a document without words has none."""
    low = lower(data)
    starts, ends, doc = words(low, offsets)
    return word_shingles(span_hashes(low, starts, ends), doc, len(offsets) - 1, width)


def word_shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same from word hashes grouped by a non-decreasing ``doc``."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    n_sh = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(n_docs), n_sh)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n_sh) - n_sh, n_sh) + np.repeat(first, n_sh)
    left = np.minimum(width, np.repeat(count, n_sh))
    padded = np.concatenate([hashes, np.zeros(width, U64)])
    out = np.zeros(len(at), U64)
    for k in range(width):
        out = np.where(left > k, mix(out * U64(_B) + padded[at + k]), out)
    return mix(out + left.astype(U64)), owner


def distinct_sets(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each owner, ascending within it, and offsets (n + 1)."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[keep], o[keep]
    return h, np.searchsorted(o, np.arange(n + 1))


def set_hashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set, from the sum of its members' hashes and its size; 0 sets hash alike."""
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(mix(values + U64(0x632BE59BD9B4E019)), out=total[1:])
    other = np.zeros(len(values) + 1, U64)
    np.cumsum(mix(values ^ U64(0xD1B54A32D192ED03)), out=other[1:])
    sizes = np.diff(offsets).astype(U64)
    a, b = total[offsets[1:]] - total[offsets[:-1]], other[offsets[1:]] - other[offsets[:-1]]
    return mix(mix(a) * U64(_B) + b + sizes)


def sliding(h: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each full window of ``width`` values."""
    done, out = 1, h
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    if done < width:
        rest = width - done
        out = pick(out[:-rest], out[rest:])
    return out


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` bytes (a polynomial modulo 2**64, not mixed)."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum(data * up[: len(data)], out=prefix[1:])
    return (prefix[width:] - prefix[:n]) * down[:n]
