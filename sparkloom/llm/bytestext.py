"""Array helpers over texts as bytes: word hashes, shingle sets, hashes of fixed-length windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240229)
BASE = np.uint64(int(_RNG.integers(1 << 62)) * 4 + 3)
#: Odd factors for the words of a shingle.
FACTORS = (_RNG.integers(1 << 62, size=64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i below n."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, b in (("up", BASE), ("down", inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(b: np.ndarray) -> np.ndarray:
    """h[i] = sum of (b[j] + 1) * BASE ** j for j < i, modulo 2 ** 64."""
    up, _ = powers(len(b) + 1)
    h = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], out=h[1:])
    return h


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of b[start:end] for each, whatever its place."""
    _, down = powers(len(h))
    return mix((h[end] - h[start]) * down[start] + (end - start).astype(np.uint64) * FACTORS[60])


def shingle_sets(texts: list[bytes], n: int = 5, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, sets, sizes) for runs of about `most` bytes: the sorted distinct hashes of each text's n-word
    shingles, end to end, and their number. A text with fewer words has one, its whole sequence; without words none."""
    sizes = [len(t) + 1 for t in texts]
    for low, high in runs(sizes, most):
        b = _LOWER[np.frombuffer(b" ".join(texts[low:high]), np.uint8)]
        gap = np.concatenate([[True], _SPACE[b], [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        w = span_hashes(prefix_hashes(b), edge[::2], edge[1::2])
        ends = np.searchsorted(edge[::2], np.cumsum(sizes[low:high]))
        words = np.diff(ends, prepend=0)
        take = np.minimum(n, words)
        count = np.where(words > 0, words - take + 1, 0)
        of = np.repeat(np.arange(high - low), count)
        at = np.arange(len(of)) + np.repeat(ends - words - (np.cumsum(count) - count), count)
        w, take = np.append(w, np.zeros(n, np.uint64)), take[of]
        total = take.astype(np.uint64)
        for k in range(n):
            total += np.where(k < take, w[at + k] * FACTORS[k], np.uint64(0))
        total, stop = mix(total), np.cumsum(count)
        for x, y in zip((stop - count).tolist(), stop.tolist(), strict=True):
            total[x:y].sort()
        new = np.ones(len(total), bool)
        new[1:] = (total[1:] != total[:-1]) | (of[1:] != of[:-1])
        yield low, total[new], np.bincount(of[new], minlength=high - low)


def shingles(text: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of one text."""
    return next(shingle_sets([text], n))[1]


def windowed_least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours: len(x) - w + 1 values."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring items of about `most` size together."""
    at = 0
    while at < len(sizes):
        end, n = at, 0
        while end < len(sizes) and (end == at or n + sizes[end] <= most):
            n += sizes[end]
            end += 1
        yield at, end
        at = end
