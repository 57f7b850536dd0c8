"""Arrow text columns as byte arrays, and their words as arrays of offsets and hashes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer document is worked on alone.
PIECE = 1 << 21
#: ``[\x20\x09-\x0D]``: what splits words in every contract.
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: All but letters, digits and the bytes of non-ASCII characters.
PUNCTUATION = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits (a bijection)."""
    h = np.asarray(h, np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _FACTOR)
_BYTE_FOLDED = _BYTE[_LOWER]


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _FACTOR, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def fold_latin(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals À to Þ made small; A-Z are folded by the hashes."""
    out = data.copy()
    if len(data) > 1:
        after = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][after] += 0x20
    return out


class Words(NamedTuple):
    """Words of several documents in order: byte offsets, the document's index, and a 64-bit hash."""

    start: np.ndarray
    stop: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first document, bytes, offsets) for runs of documents of ``limit`` bytes in all; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, width)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = BLANK, fold: bool = True, also: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes that are no separators, within documents; ``fold`` hashes A-Z as a-z.

    ``also`` marks positions that belong to words although they hold a separator byte (which does not count in the hash).
    """
    n = len(data)
    inside = ~separator[data]
    if also is not None:
        inside |= also
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1] | edge[1:n]
        last[:-1] &= ~inside[1:] | edge[1:n]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    values = np.where(separator, np.uint64(0), _BYTE_FOLDED if fold else _BYTE)
    out = np.empty(len(start), np.uint64)
    power = _powers(int((stop - start).max(initial=1)))
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(stop, start[i] + PIECE, "right")))
        begin = start[i:j] - start[i]
        part = data[start[i]:stop[j - 1]]
        at = np.arange(len(part)) - np.repeat(begin, np.diff(np.append(begin, len(part))))
        out[i:j] = np.add.reduceat(values[part] * power[np.minimum(at, len(power) - 1)], begin)
        i = j
    return Words(start, stop, doc, mix(out))


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of ``size`` words within one document."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = mix(h * _FACTOR + hashes[k:k + n])
    at = np.flatnonzero(doc[:n] == doc[size - 1:])
    return at, h[at]
