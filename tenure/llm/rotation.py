"""One-bit codes of randomly rotated vectors, with the factor that makes estimates unbiased.

A unit vector is rotated at random and only the signs are kept. With ``f`` the inner product
of the vector and its code (scaled to length 1), the inner product of code and any unit vector,
divided by ``f``, is an unbiased estimate of the true one; its error is at most
``eps * sqrt((1 - f^2) / f^2 / (d - 1))`` except with a probability that falls like exp(-c eps^2).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=64)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of rotated unit vectors (rows) and their correction factors."""
    turned = unit @ rotation(unit.shape[1], seed)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(unit.shape[1])


def signs(packed: np.ndarray, dim: int) -> np.ndarray:
    """+1 and -1, scaled to unit length."""
    return (np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))


def estimates(packed: np.ndarray, factor: np.ndarray, unit: np.ndarray, seed: int = 0) -> np.ndarray:
    """Estimated inner products, coded vectors by given unit vectors."""
    dim = unit.shape[1]
    turned = (unit @ rotation(dim, seed)).astype(np.float32)
    return signs(packed, dim) @ turned.T / factor.astype(np.float32)[:, None]


def bound(factor: np.ndarray, dim: int, eps: float) -> np.ndarray:
    """Half-width of the confidence interval of a coded vector's estimates."""
    return eps * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1))


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))
