"""Vectorised word and shingle kernels over the UTF-8 buffers of Arrow string columns.

Texts are handled where Arrow keeps them, as one byte buffer with offsets, so no Python string is made for a word.
Working arrays are bounded: callers pass slices of about ``SLICE_BYTES`` (one longer text alone).
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
#: Longer words are hashed one by one.
LONG = 512
_P = 0x9E3779B97F4A7C15 | 1
_KEY = np.uint64(0x8D1F2A64C93B57E1)
#: Masks of the first 0 to 8 bytes of a little-endian integer.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Bytes that end a word: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end an alphanumeric word: ASCII other than digits and letters (A-Z are lower-cased first).
PUNCT = np.zeros(256, bool)
PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def returned() -> None:
    """Give memory that is free back to the system: a worker keeps what its largest batch took, and it lives as long as its
    executor, beside whatever other tasks need."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES):
    """Consecutive row slices of a batch with about ``limit`` bytes of text each."""
    _, offsets = buffers(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end
    returned()


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; words end at separators and at text ends."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = ~sep[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    before[cut] = False
    after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _loads(data: np.ndarray, lower: bool) -> np.ndarray:
    """The eight bytes that begin at each byte, as integers; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = LOWER[data] if lower else data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, heads: bool = False):
    """64-bit hash of each word's bytes (A-Z lower-cased); equal words have equal hashes wherever they stand. Eight bytes at a
    time go through a bijection of 64 bits, so words of up to eight bytes and of one length never meet. heads: the first
    eight bytes of each word, too."""
    loads, size = _loads(data, lower), ends - starts
    first = loads[starts] & _FIRST[np.minimum(size, 8)]
    with np.errstate(over="ignore"):
        h = mix64(first ^ mix64(size.astype(np.uint64) * np.uint64(_P) + _KEY))
        on, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(on):
            rest = size[on] - at
            h[on] = mix64((h[on] ^ (loads[starts[on] + at] & _FIRST[np.minimum(rest, 8)])) * np.uint64(_P) + _KEY)
            on, at = on[rest > 8], at + 8
    for i in np.flatnonzero(size > LONG).tolist():
        word = data[starts[i] : ends[i]]
        word = LOWER[word] if lower else word
        h[i] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8, key=_KEY.tobytes()).digest(), "little")
    return (h, first) if heads else h


def shingles(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of k words; a text of fewer words, but not none, gives its whole sequence."""
    with np.errstate(over="ignore"):
        coef = mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(_P)) | np.uint64(1)
        n = len(h)
        if n >= k:
            s = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                s += h[j : n - k + 1 + j] * coef[j]
            ok = doc[: n - k + 1] == doc[k - 1 :]
            full, owner = mix64(s[ok] ^ np.uint64(k)), doc[: n - k + 1][ok]
        else:
            full, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        ids, first, count = np.unique(doc, return_index=True, return_counts=True)
        few = count < k
        if few.any():
            ids, first, count = ids[few], first[few], count[few]
            s = np.zeros(len(ids), np.uint64)
            for j in range(k - 1):
                has = count > j
                s[has] += h[first[has] + j] * coef[j]
            short = mix64(s ^ count.astype(np.uint64))
            full, owner = np.r_[full, short], np.r_[owner, ids]
            order = np.argsort(owner, kind="stable")
            full, owner = full[order], owner[order]
    return full, owner


def list_array(flat: np.ndarray, lengths) -> pa.Array:
    """A list column from its flattened values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
