"""Static binary-fuse filters over 64-bit keys, built and probed with array operations.

Each key has three slots in consecutive segments of a byte table; the exclusive or of the three bytes is the
key's fingerprint. About nine bits a key and one false positive in 256. A filter never misses a key it was built from.
"""

from __future__ import annotations

import math

import numpy as np

from millrace.llm.bytes_ import mix64

_HEADER = 3  # seed, segment length, segment count, as 64-bit numbers before the table
MAX_SEEDS = 64


def _shape(keys: int) -> tuple[int, int]:
    length = 1 << min(18, max(2, int(math.log(max(keys, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(max(keys, 2)))
    return length, max(1, math.ceil(keys * factor / length)) + 2


def _slots(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots of each key, and its fingerprint."""
    h = mix64(keys + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    first = (((h >> np.uint64(32)) * np.uint64(segments - 2)) >> np.uint64(32)).astype(np.int64) * length
    mask = np.uint64(length - 1)
    inside = [(h & mask), (h >> np.uint64(18)) & mask, (mix64(h) & mask)]
    slots = np.stack([first + i * length + x.astype(np.int64) for i, x in enumerate(inside)])
    return slots, (mix64(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(56)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter over distinct uint64 keys."""
    length, segments = _shape(len(keys))
    for seed in range(MAX_SEEDS):
        slots, prints = _slots(keys, seed, length, segments)
        order = _peeled(slots, length * segments)
        if order is not None:
            break
    else:
        raise ValueError("keys are not distinct")
    table = np.zeros(length * segments, np.uint8)
    for keys_, place in reversed(order):
        # A slot that was alone holds no other key of its layer, so a layer is assigned at once.
        table[place] = 0
        table[place] = prints[keys_] ^ table[slots[0, keys_]] ^ table[slots[1, keys_]] ^ table[slots[2, keys_]]
    return np.array([seed, length, segments], np.uint64).tobytes() + table.tobytes()


def _peeled(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Layers of keys with a slot of their own, in the order of removal; None if some keys stay tangled."""
    n = slots.shape[1]
    degree = np.bincount(slots.ravel(), minlength=size)
    held = np.zeros(size, np.int64)
    which = np.arange(n)
    for row in slots:
        np.bitwise_xor.at(held, row, which)
    layers, left = [], n
    places = np.flatnonzero(degree == 1)
    while left:
        if not len(places):
            return None
        keys, first = np.unique(held[places], return_index=True)
        layers.append((keys, places[first]))
        left -= len(keys)
        gone = slots[:, keys]
        np.subtract.at(degree, gone.ravel(), 1)
        for row in gone:
            np.bitwise_xor.at(held, row, keys)
        touched = np.unique(gone)
        places = touched[degree[touched] == 1]
    return layers


def contains(filter_: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be among those of the filter."""
    seed, length, segments = (int(x) for x in np.frombuffer(filter_, np.uint64, _HEADER))
    table = np.frombuffer(filter_, np.uint8, offset=8 * _HEADER)
    slots, prints = _slots(keys, seed, length, segments)
    return (table[slots[0]] ^ table[slots[1]] ^ table[slots[2]]) == prints
