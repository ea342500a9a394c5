"""Word boundaries and 64-bit word hashes of Arrow text columns, computed on the UTF-8 bytes.

All sizes of intermediate arrays are bounded: texts are taken in chunks of about a megabyte, and the
running sums of one very long text in pieces of the same size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_SHINGLE_KEYS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads all bits (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
# One random number for each byte, A-Z as a-z.
_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)[_FOLD]
_PIECE = 1 << 14
_INVERSE = pow(int(_MULTIPLIER), -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i from 0."""
    return np.concatenate([np.ones(1, np.uint64), np.full(count - 1, base, np.uint64)]).cumprod(dtype=np.uint64)


_POWERS = _powers(int(_MULTIPLIER), _PIECE + 1)
_INVERSES = _powers(_INVERSE, _PIECE)


@dataclass
class Words:
    """Words of consecutive texts: hashes, byte spans within ``data``, and where each text's words begin."""

    first: int
    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray  # words of text i are offsets[i] to offsets[i + 1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows. NULL counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    return (np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``limit`` bytes together, one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def _sums_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sums of code times power over the bytes before each place; places ascend."""
    out = np.zeros(len(places), np.uint64)
    carry, shift, a = np.uint64(0), 1, 0
    for low in range(0, len(data), _PIECE):
        piece = _BYTE_CODES[data[low : low + _PIECE]]
        piece *= _POWERS[: len(piece)]
        sums = np.empty(len(piece) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(piece, dtype=np.uint64, out=sums[1:])
        sums *= np.uint64(shift)
        sums += carry
        b = int(np.searchsorted(places, low + len(piece), side="right"))
        out[a:b] = sums[places[a:b] - low]
        a, carry, shift = b, sums[-1], shift * int(_POWERS[_PIECE]) % (1 << 64)
    return out


def hash_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word ``[^\\x20\\x09-\\x0D]+``; a word ends at a bound as well."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    word = ~_SPACE[data]
    apart = np.zeros(len(data) + 1, dtype=bool)
    apart[bounds] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | apart[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | apart[1:])) + 1
    sums = _sums_at(data, ends) - _sums_at(data, starts)
    far = _powers(pow(_INVERSE, _PIECE, 1 << 64), len(data) // _PIECE + 1)
    scale = _INVERSES[starts % _PIECE] * far[starts // _PIECE]
    return mix64(sums * scale + (ends - starts).astype(np.uint64)), starts, ends


def words(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of a text column, chunk by chunk."""
    raw, offsets = text_bytes(column)
    for first, last in chunks(offsets, limit):
        bounds = offsets[first : last + 1] - offsets[first]
        data = raw[offsets[first] : offsets[last]]
        hashes, starts, ends = hash_words(data, bounds)
        yield Words(first, data, hashes, starts, ends, np.searchsorted(starts, bounds, side="left"))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words; the whole sequence where there are fewer."""
    n = min(size, len(hashes))
    if not n:
        return hashes
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        key = _SHINGLE_KEYS[i % 4] + np.uint64(2 * (i // 4))
        out += hashes[i : len(hashes) - n + 1 + i] * key
    return mix64(out + np.uint64(n))
