"""Arithmetic of GF(2^8) modulo x^8 + x^4 + x^3 + x^2 + 1 and erasure coding over it, on numpy byte arrays."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

POLYNOMIAL = 0x11D


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(product of every two elements, inverse of each; that of zero is zero)."""
    powers, x = [], 1
    for _ in range(255):
        powers.append(x)
        x = x << 1 ^ (POLYNOMIAL if x & 0x80 else 0)
    log = np.zeros(256, np.int64)
    log[powers] = np.arange(255)
    power = np.array(powers, np.uint8)
    product = power[(log[:, None] + log[None, :]) % 255]
    product[0, :] = product[:, 0] = 0
    inverse = power[(255 - log) % 255]
    inverse[0] = 0
    return product, inverse


@cache
def generator(k: int, r: int) -> np.ndarray:
    """Row i holds the powers of i + 1; row 0 is all ones."""
    product, _ = tables()
    out = np.ones((r, k), np.uint8)
    for c in range(1, k):
        out[:, c] = product[out[:, c - 1], np.arange(1, r + 1, dtype=np.uint8)]
    return out


def combine(row: np.ndarray, shards: np.ndarray) -> np.ndarray:
    """Sum of coefficient times shard."""
    product, _ = tables()
    out = np.zeros(shards.shape[1], np.uint8)
    for c, shard in zip(row.tolist(), shards, strict=True):
        if c:
            out ^= product[c][shard]
    return out


def encode(shards: np.ndarray, r: int) -> np.ndarray:
    """(r, length) parity of (k, length) data."""
    return np.stack([combine(row, shards) for row in generator(len(shards), r)])


def solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """Gauss-Jordan elimination; None if the matrix is singular."""
    product, inverse = tables()
    m, b = matrix.copy(), right.copy()
    for c in range(len(m)):
        pivot = next((i for i in range(c, len(m)) if m[i, c]), None)
        if pivot is None:
            return None
        m[[c, pivot]], b[[c, pivot]] = m[[pivot, c]], b[[pivot, c]]
        scale = inverse[m[c, c]]
        m[c], b[c] = product[scale][m[c]], product[scale][b[c]]
        for i in range(len(m)):
            if i != c and m[i, c]:
                f = m[i, c]
                m[i] ^= product[f][m[c]]
                b[i] ^= product[f][b[c]]
    return b


def recover(shards: list[np.ndarray | None], parity: list[np.ndarray | None]) -> list[np.ndarray] | None:
    """All shards, the missing ones solved from parity rows known by number; None if there are too few independent rows."""
    missing = [i for i, s in enumerate(shards) if s is None]
    if not missing:
        return list(shards)
    g = generator(len(shards), len(parity))
    rows = [i for i, p in enumerate(parity) if p is not None]
    length = len(next((x for x in [*shards, *parity] if x is not None), b""))
    known = np.stack([np.zeros(length, np.uint8) if s is None else s for s in shards])
    for chosen in combinations(rows, len(missing)):
        right = np.stack([parity[i] ^ combine(g[i], known) for i in chosen])
        found = solve(g[np.ix_(chosen, missing)], right)
        if found is not None:
            out = list(shards)
            for i, shard in zip(missing, found, strict=True):
                out[i] = shard
            return out
    return None
