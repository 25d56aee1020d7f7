"""Number-theoretic transforms of rows of integers, in numpy: exact cyclic correlations."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Primes below 2^31, one more than a multiple of 2^25, each with a primitive root. Transforms have up to 2^25 entries.
PRIMES = ((2013265921, 31), (2113929217, 5), (1811939329, 13))


def primes_for(bound: int) -> tuple[tuple[int, int], ...]:
    """The first primes whose product is above bound: a number from 0 to bound is zero exactly if it is zero modulo each."""
    product = 1
    for i, (p, _) in enumerate(PRIMES):
        product *= p
        if product > bound:
            return PRIMES[: i + 1]
    raise ValueError(f"no exact transform for values up to {bound}")


@lru_cache(maxsize=256)
def powers(n: int, p: int, root: int, inverse: bool) -> np.ndarray:
    """The first n // 2 powers of a primitive n-th root of one, or of its inverse."""
    w = pow(root, (p - 1) // n, p)
    w = pow(w, p - 2, p) if inverse else w
    out = np.ones(max(n // 2, 1), np.uint64)
    done = 1
    while done < len(out):
        k = min(done, len(out) - done)
        out[done : done + k] = out[:k] * np.uint64(pow(w, done, p)) % np.uint64(p)
        done += k
    return out


def transform(x: np.ndarray, p: int, root: int, inverse: bool = False) -> np.ndarray:
    """The transform of each row of x (entries below p, a power of two of them), in natural order; without the last division by n where inverse."""
    rows, n = x.shape
    q, half, stride = np.uint64(p), n // 2, 1
    w = powers(n, p, root, inverse)
    while half:
        x = x.reshape(rows, 2, half, stride)
        low, high = x[:, 0], x[:, 1]
        out = np.empty((rows, half, 2, stride), np.uint64)
        np.add(low, high, out=out[:, :, 0])
        apart = low + (q - high)
        apart %= q
        apart *= w[::stride].reshape(half, 1)
        np.remainder(apart, q, out=out[:, :, 1])
        np.remainder(out[:, :, 0], q, out=out[:, :, 0])
        x, half, stride = out, half // 2, stride * 2
    return x.reshape(rows, n)


def correlations(blocks: np.ndarray, windows: np.ndarray, p: int, root: int) -> np.ndarray:
    """For each row the sums over i of block[i] window[t + i], modulo p, for t from 0 to window - block.

    windows has a power of two of columns, enough that none of these sums wraps around.
    """
    rows, n = windows.shape
    turned = np.zeros((rows, n), np.uint64)
    turned[:, 0] = blocks[:, 0]
    turned[:, n - blocks.shape[1] + 1 :] = blocks[:, :0:-1]
    found = transform(turned, p, root)
    found *= transform(windows, p, root)
    found %= np.uint64(p)
    found = transform(found, p, root, inverse=True)
    found *= np.uint64(pow(n, p - 2, p))
    found %= np.uint64(p)
    return found
