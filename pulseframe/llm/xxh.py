"""XXH64 of many slices of one buffer at once, in numpy (the public xxHash specification)."""

from __future__ import annotations

import numpy as np

# Fixed values of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_slices(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[s:e] for each s, e."""
    padded = data + bytes(8)
    u8 = np.frombuffer(padded, np.uint8)
    u64 = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    u32 = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    seed = np.uint64(seed)
    pos, size = starts.astype(np.int64), (ends - starts).astype(np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(pos), seed + P5, np.uint64)
        rows = np.flatnonzero(size >= 32)
        if len(rows):
            acc = [np.full(len(rows), v, np.uint64) for v in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            at, stripes = pos[rows], size[rows] >> 5
            for s in range(int(stripes.max())):
                on = np.flatnonzero(stripes > s)
                for i in range(4):
                    acc[i][on] = rotl(acc[i][on] + u64[at[on] + (32 * s + 8 * i)] * P2, 31) * P1
            x = rotl(acc[0], 1) + rotl(acc[1], 7) + rotl(acc[2], 12) + rotl(acc[3], 18)
            for v in acc:
                x = (x ^ (rotl(v * P2, 31) * P1)) * P1 + P4
            h[rows] = x
        h += size.view(np.uint64)
        pos = pos + (size & ~31)
        left = size & 31
        rows = np.flatnonzero(left >= 8)
        while len(rows):
            h[rows] = rotl(h[rows] ^ (rotl(u64[pos[rows]] * P2, 31) * P1), 27) * P1 + P4
            pos[rows] += 8
            left[rows] -= 8
            rows = rows[left[rows] >= 8]
        rows = np.flatnonzero(left >= 4)
        h[rows] = rotl(h[rows] ^ (u32[pos[rows]].astype(np.uint64) * P1), 23) * P2 + P3
        pos[rows] += 4
        left[rows] -= 4
        rows = np.flatnonzero(left > 0)
        while len(rows):
            h[rows] = rotl(h[rows] ^ (u8[pos[rows]].astype(np.uint64) * P5), 11) * P1
            pos[rows] += 1
            left[rows] -= 1
            rows = rows[left[rows] > 0]
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))
