"""All windows of a series at once, from running sums: numpy kernels on stacks of equally long series.

A window's moments, segment means and Fourier values are differences of prefix sums, so each costs the
same whatever the width is. Differences lose digits where a window varies much less than its series;
such windows are summed on their own. Whether a window is constant is told exactly, by comparing neighbours.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np

#: Rows that are worked out at a time: their windows' values stay in a processor's cache.
STACK = 512

#: A window whose variance is below this share of its series' mean square is summed on its own.
LOST = 1e-7


@dataclass(frozen=True)
class Words:
    """SAX or SFA words: window, letters, alphabet."""

    kind: str
    width: int
    length: int
    alphabet: int = 4
    norm_mean: bool = False


def prefix(a: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... values of each row."""
    return np.concatenate([np.zeros((len(a), 1), a.dtype), np.cumsum(a, 1)], 1)


def windows(a: np.ndarray, width: int) -> np.ndarray:
    """(rows, windows, width) without copying."""
    return np.lib.stride_tricks.sliding_window_view(a, width, 1)


def moments(a: np.ndarray, width: int, sample: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and deviation of every window, and which windows were summed on their own."""
    base = a.mean(1, keepdims=True)
    c = a - base
    s, q = prefix(c), prefix(c * c)
    mu = (s[:, width:] - s[:, :-width]) / width
    var = (q[:, width:] - q[:, :-width]) / width - mu * mu
    weak = var < LOST * (a * a).mean(1, keepdims=True)
    mu = mu + base
    if weak.any():
        own = windows(a, width)[weak]
        mu[weak], var[weak] = own.mean(1), own.var(1)
    still = prefix((a[:, 1:] != a[:, :-1]).astype(np.int64))
    var[still[:, width - 1 :] == still[:, : a.shape[1] - width + 1]] = 0.0
    if sample:
        var = var * (width / (width - 1)) if width > 1 else np.zeros_like(var)
    return mu, np.sqrt(np.maximum(var, 0)), weak


def paa(a: np.ndarray, width: int, parts: int) -> np.ndarray:
    """(rows, windows, parts): means of a window's equal parts, points on a border counted by overlap; a window of
    at most `parts` values as it is."""
    if width <= parts:
        return windows(a, width)
    base = a.mean(1, keepdims=True)
    s = prefix(a - base)
    n = a.shape[1] - width + 1
    size = width / parts

    def upto(k: int) -> np.ndarray:
        """The sum before the k-th border of each window, linear inside a point."""
        at = k * size
        low = min(int(at + 1e-9), width)
        share = at - low
        out = s[:, low : low + n]
        return out if share < 1e-9 else out + share * (s[:, low + 1 : low + 1 + n] - out)

    edges = [upto(k) for k in range(parts + 1)]
    return np.stack([(hi - lo) / size for lo, hi in zip(edges, edges[1:], strict=False)], 2) + base[:, :, None]


def sax(a: np.ndarray, width: int, parts: int, cuts: np.ndarray, flat: float = 0.001) -> np.ndarray:
    """(rows, windows, letters) as numbers: normalised by the sample's deviation, zeros where that is under `flat`."""
    if len(a) > STACK:
        return np.concatenate([sax(a[k : k + STACK], width, parts, cuts, flat) for k in range(0, len(a), STACK)])
    mu, sd, weak = moments(a, width, sample=True)
    means = np.array(paa(a, width, parts))
    if weak.any():
        means[weak] = np.stack([paa(w[None], width, parts)[0, 0] for w in windows(a, width)[weak]])
    dull = sd < flat
    z = (means - mu[:, :, None]) / np.where(dull, 1, sd)[:, :, None]
    z[dull] = 0
    return numbered(z, cuts)


def numbered(z: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many cuts lie at or below each value, give or take a rounding error; cuts are (alphabet - 1) or, for the last
    axis of z, (letters, alphabet - 1)."""
    out = np.zeros(z.shape, np.uint8)
    for k in range(cuts.shape[-1]):
        out += z >= cuts[..., k] - 1e-12
    return out


@lru_cache(4096)
def turns(f: int, width: int, length: int) -> np.ndarray:
    """e^(-2 pi i f s / width) for s = 0 .. length - 1."""
    out = np.exp(-2j * math.pi * (f * np.arange(length) % width) / width)
    out.flags.writeable = False
    return out


def fourier(a: np.ndarray, width: int, length: int, norm_mean: bool = False, step: int = 1, cells: int = 1 << 14) -> np.ndarray:
    """(rows, windows, length): packed Fourier values, of every step-th window divided by its deviation (1 if that is 0) and
    sqrt(width), every second one negated; with norm_mean the constant part is left out.

    X_t[k] = e^(2 pi i k t / width) (P[t + width] - P[t]) with P the prefix sums of x_s e^(-2 pi i k s / width).
    Of few rows all frequencies are worked out at once, as many as fit `cells`.
    """
    if len(a) > STACK:
        return np.concatenate([fourier(a[k : k + STACK], width, length, norm_mean, step, cells) for k in range(0, len(a), STACK)])
    _, sd, weak = (m[:, ::step] for m in moments(a, width))
    rows, n, size = len(a), a.shape[1] - width + 1, a.shape[1]
    skip = 2 if norm_mean else 0
    out = np.zeros((rows, sd.shape[1], length))
    c = a - a.mean(1, keepdims=True)  # only X[0] knows the mean
    first, last = skip // 2, min((skip + length - 1) // 2, width // 2)
    most = max(1, cells // max(1, rows * size))
    for low in range(first, last + 1, most):
        some = range(low, min(low + most, last + 1))
        turn = np.stack([turns(f, width, size) for f in some])
        moved = c[:, None, :] * turn
        if low == 0:
            moved[:, 0] = a * turn[0]
        p = np.zeros((rows, len(some), size + 1), complex)
        np.cumsum(moved, 2, out=p[:, :, 1:])
        x = (p[:, :, width::step] - p[:, :, :n:step]) * np.conj(turn[:, :n:step])
        for i, f in enumerate(some):
            if weak.any():
                x[:, i][weak] = windows(a, width)[:, ::step][weak] @ turn[i, :width]
            for k, value in ((2 * f, x[:, i].real), (2 * f + 1, x[:, i].imag)):
                if skip <= k < skip + length and k != 1 and not (k % 2 and 2 * f == width):
                    out[:, :, k - skip] = value * (-1.0 if (k - skip) % 2 else 1.0)
    return out / (math.sqrt(width) * np.where(sd == 0, 1, sd))[:, :, None]


def rounded(v: np.ndarray) -> np.ndarray:
    """Two decimals, halves away from zero, no negative zero."""
    return np.copysign(np.floor(np.abs(v) * 100 + 0.5) / 100, v) + 0.0


def sfa(a: np.ndarray, p: Words, cuts: np.ndarray) -> np.ndarray:
    """(rows, windows, letters) as numbers: cuts (length, alphabet - 1) at or below each Fourier value."""
    return numbered(fourier(a, p.width, p.length, p.norm_mean), cuts)


def letters(a: np.ndarray, p: Words, cuts: np.ndarray) -> np.ndarray:
    """Words of a parameter: cuts are the Gaussian ones for SAX, learned ones for SFA."""
    return sax(a, p.width, p.length, cuts) if p.kind == "SAX" else sfa(a, p, cuts)


def spelled(numbers: np.ndarray) -> np.ndarray:
    """Words of the last axis's numbers as bytes."""
    return np.ascontiguousarray(numbers + 97).view(f"S{numbers.shape[-1]}")[..., 0]


def packed(numbers: np.ndarray, alphabet: int) -> np.ndarray:
    """(..., columns) uint64 in which the k-th letter sets k of its bits, so that the bits in which two words differ
    are their letters' distances."""
    bits = alphabet - 1
    per = max(1, 64 // bits)
    marks = ((np.uint64(1) << numbers.astype(np.uint64)) - np.uint64(1)) if bits < 64 else None
    out = np.zeros((*numbers.shape[:-1], -(-numbers.shape[-1] // per)), np.uint64)
    for i in range(numbers.shape[-1]):
        out[..., i // per] |= marks[..., i] << np.uint64(bits * (i % per))
    return out


def least_distances(codes: np.ndarray, queries: np.ndarray, cells: int = 1 << 18, many: int = 512) -> np.ndarray:
    """(rows, queries): of packed() words (rows, windows, columns) the least distance to each query (queries, columns).
    Many rows meet one query at a time, few rows all of them."""
    rows, n, columns = codes.shape
    out = np.empty((rows, len(queries)), np.int32)
    step = max(1, cells // max(1, n * len(queries)))
    kind = np.uint8 if columns < 4 else np.uint16  # a column counts 64 at most
    if rows >= many // 4:
        for at in range(0, rows, many):
            here = [np.ascontiguousarray(codes[at : at + many, :, c].T) for c in range(columns)]
            best = np.empty((len(queries), here[0].shape[1]), kind)
            for k, q in enumerate(queries):
                d = reduce(np.add, (np.bitwise_count(own ^ q[c]).astype(kind, copy=False) for c, own in enumerate(here)))
                d.min(0, out=best[k])
            out[at : at + many] = best.T
        return out
    for at in range(0, rows, step):
        here = codes[at : at + step]
        d = reduce(np.add, (np.bitwise_count(here[:, :, None, c] ^ queries[None, None, :, c]).astype(kind, copy=False) for c in range(columns)))
        out[at : at + step] = d.min(1)
    return out
