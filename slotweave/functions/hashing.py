"""Hash functions that Spark lacks, over numpy arrays of unsigned words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_MASK64 = (1 << 64) - 1


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for byte in data:
        h = (h ^ byte) * 0x100000001B3 & _MASK64
    return h


def _by_length(items: Iterable[bytes], block: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(positions, bytes, length) of the items of each length; the bytes are filled up with zeros to whole blocks."""
    groups: dict[int, list[int]] = {}
    items = list(items)
    for i, data in enumerate(items):
        groups.setdefault(len(data), []).append(i)
    for length, at in groups.items():
        rows = np.zeros((len(at), -(-length // block) * block), np.uint8)
        rows[:, :length] = np.frombuffer(b"".join(items[i] for i in at), np.uint8).reshape(len(at), length)
        yield np.array(at), rows, length


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    kind = x.dtype.type
    return x << kind(r) | x >> kind(8 * x.dtype.itemsize - r)


def _fmix64(k: np.ndarray) -> np.ndarray:
    for constant in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        k = (k ^ k >> np.uint64(33)) * np.uint64(constant)
    return k ^ k >> np.uint64(33)


def murmur3_128(items: Iterable[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit halves of MurmurHash3 x64-128 of each item, as uint64; items of one length are hashed together."""
    items = list(items)
    c1, c2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
    out = np.zeros((2, len(items)), np.uint64)
    for at, rows, length in _by_length(items, 16):
        h1 = np.full(len(at), seed, np.uint64)
        h2 = h1.copy()
        words = rows.view("<u8").astype(np.uint64).reshape(len(at), -1)
        for n in range(0, words.shape[1], 2):
            h1 ^= _rotl(words[:, n] * c1, 31) * c2
            if n // 2 < length // 16:  # a whole block; the rest of an item is only mixed in, h2 as well as h1
                h1 = (_rotl(h1, 27) + h2) * np.uint64(5) + np.uint64(0x52DCE729)
            h2 ^= _rotl(words[:, n + 1] * c2, 33) * c1
            if n // 2 < length // 16:
                h2 = (_rotl(h2, 31) + h1) * np.uint64(5) + np.uint64(0x38495AB5)
        h1, h2 = h1 ^ np.uint64(length), h2 ^ np.uint64(length)
        h1 = h1 + h2
        h2 = h2 + h1
        h1, h2 = _fmix64(h1), _fmix64(h2)
        h1 = h1 + h2
        out[:, at] = h1, h2 + h1
    return out[0], out[1]


def murmur3_32(items: Iterable[bytes], seeds: np.ndarray) -> np.ndarray:
    """MurmurHash3 x86-32 of each item (rows) under each seed (columns), as uint32; items of one length are hashed together."""
    items = list(items)
    c1, c2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
    out = np.zeros((len(items), len(seeds)), np.uint32)
    for at, rows, length in _by_length(items, 4):
        h = np.tile(seeds.astype(np.uint32), (len(at), 1))
        words = rows.view("<u4").astype(np.uint32).reshape(len(at), -1)
        for n in range(words.shape[1]):
            h ^= (_rotl(words[:, n] * c1, 15) * c2)[:, None]
            if n < length // 4:
                h = _rotl(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(length)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        out[at] = h ^ (h >> np.uint32(16))
    return out
