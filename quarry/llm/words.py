"""Vectorised words of UTF-8 texts: places and 64-bit identifiers of all words of a block of
documents, taken straight from Arrow's byte buffer.

A word's identifier is a polynomial hash (random 64-bit byte values, modulus 2^64) read off one
running sum over the block, then finalised; equal words have equal identifiers in every task.
Two different words share one with probability about 2^-64."""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass works on; a longer document is a block of its own.
BLOCK_BYTES = 256 << 10

KEPT_POWERS = 1 << 20

_BYTES = np.arange(256)
#: Bytes of words ``[^\x20\x09-\x0D]+``. Bytes of one code point are all inside or all outside.
SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after A-Z are lower-cased).
LETTERED = (((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80))
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n. Kept up to KEPT_POWERS only."""
    if len(_powers[0]) > n:
        return _powers[0], _powers[1]
    got = []
    for base in (_BASE, _BASE_INVERSE):
        p = np.full(max(n, KEPT_POWERS) + 1, base, np.uint64)
        p[0] = 1
        got.append(np.cumprod(p, dtype=np.uint64))
    if n <= KEPT_POWERS:
        _powers[:] = got
    return got[0], got[1]


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0]:offs[-1]], offs - offs[0]


def blocks(column, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows of at most ``limit`` bytes."""
    buf, offs = raw(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


class Words(NamedTuple):
    start: np.ndarray   # byte where each word starts
    end: np.ndarray     # byte after its last
    ident: np.ndarray   # 64-bit identifier, never 0
    bound: np.ndarray   # document d has the words bound[d] to bound[d + 1] - 1

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bound) - 1), np.diff(self.bound))


def spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``inside`` bytes that do not cross documents."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = inside[buf]
    before, after = np.empty_like(m), np.empty_like(m)
    before[0], before[1:] = False, m[:-1]
    after[-1], after[:-1] = False, m[1:]
    edge = offs[(offs > 0) & (offs < len(buf))]
    before[edge], after[edge - 1] = False, False
    return np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1


def span_ident(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Identifiers of the byte runs [start, end) of one block."""
    power, inverse = _power(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[buf] * power[:len(buf)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93)) | _U(1)


def words(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> Words:
    start, end = spans(buf, offs, inside)
    return Words(start, end, span_ident(buf, start, end), np.searchsorted(start, offs))


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, identifier) of every run of ``k`` words inside one document."""
    n = len(w.ident)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = w.ident[:n - k + 1].copy()
    for j in range(1, k):
        h = mix(h * _U(_BASE) + w.ident[j:n - k + 1 + j])
    last = np.repeat(w.bound[1:], np.diff(w.bound))  # index after the document's last word
    at = np.flatnonzero(np.arange(n - k + 1) + k <= last[:n - k + 1])
    return at, h[at]


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..l0-1, 0..l1-1, ... for the given lengths, in one array."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
