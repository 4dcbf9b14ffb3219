"""Numeric kernels on array columns, as Catalyst expressions: nothing here leaves the JVM.

Windows, segments and coefficients have lengths that are known when a plan is built, so their sums
become plain arithmetic on array elements, which whole-stage code generation compiles; only the
kernels over whole series and windows wider than WIDE use higher-order functions, as code for so many
terms would neither plan nor compile well.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = 32


def zero() -> Column:
    return F.lit(0.0)


def r6(c: Column) -> Column:
    """Six decimals and no negative zero, for results that are compared across engines."""
    return F.round(c, 6) + zero()


def total(x: Column, term: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.aggregate(x, zero(), lambda a, v: a + term(v))


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def sd_pop(x: Column) -> Column:
    """sqrt(E[x^2] - mean^2), 0 where that is not positive."""
    var = total(x, lambda v: v * v) / F.size(x) - mean(x) * mean(x)
    return F.when(var > 0, F.sqrt(var)).otherwise(0.0)


def sd_sample(x: Column) -> Column:
    n = F.size(x)
    var = (n * total(x, lambda v: v * v) - total(x) * total(x)) / (n * (n - 1))
    return F.when(n < 2, 0.0).when(var > 0, F.sqrt(var)).otherwise(0.0)


def median(x: Column) -> Column:
    """The middle of the sorted values, the mean of two for an even number of them; null for none."""
    n, at = F.size(x), F.array_sort(x)
    middle = lambda k: F.get(at, k.cast("int"))
    return F.when(n > 0, (middle((n - 1) / 2) + middle(n / 2)) / 2)


def with_moments(df: DataFrame, x: str = "x", sample: bool = False) -> DataFrame:
    """mu and sigma as columns of their own, so that they are worked out once per row."""
    return df.withColumn("mu", mean(F.col(x))).withColumn("sigma", (sd_sample if sample else sd_pop)(F.col(x)))


def znorm_pop(x: str = "x", norm_mean: bool = True) -> Column:
    """(x - mu) / sigma with the population's deviation, a constant series divided by 1."""
    by = F.when(F.col("sigma") == 0, 1.0).otherwise(F.col("sigma"))
    return F.transform(x, lambda v: (v - F.col("mu") if norm_mean else v) / by)


def znorm_sample(x: str = "x", flat: float = 0.001) -> Column:
    """(x - mu) / sigma with the sample's deviation; all zeros where that is under `flat`."""
    return F.transform(x, lambda v: F.when(F.col("sigma") < flat, 0.0).otherwise((v - F.col("mu")) / F.col("sigma")))


def windows(df: DataFrame, width: int, x: str = "x") -> DataFrame:
    """A row per window of `width`: offset and w, the x column gone. Shorter series have none."""
    last = F.size(x) - width
    spans = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(x, i + 1, F.lit(width))))
    return df.select(*[c for c in df.columns if c != x], F.posexplode(spans).alias("offset", "w"))


def disjoint(df: DataFrame, width: int, x: str = "x") -> DataFrame:
    """A row per whole block of `width`: block and w."""
    last = F.floor(F.size(x) / width).cast("int") - 1
    spans = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(x, i * width + 1, F.lit(width))))
    return df.select(*[c for c in df.columns if c != x], F.posexplode(spans).alias("block", "w"))


def added(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms) if terms else zero()


def window_moments(w: Column, width: int, sample: bool = False) -> tuple[Column, Column]:
    """Mean and deviation of a window of known width, unrolled unless it is wide."""
    if width > WIDE:
        return mean(w), (sd_sample if sample else sd_pop)(w)
    items = [w[i] for i in range(width)]
    mu, squares = added(items) / width, added([v * v for v in items])
    if sample:
        var = (width * squares - added(items) * added(items)) / (width * (width - 1))
    else:
        var = squares / width - mu * mu
    return mu, F.when(var > 0, F.sqrt(var)).otherwise(0.0)


def paa_weights(width: int, parts: int) -> list[list[tuple[int, float]]]:
    """For each part the (position, share) pairs of its mean; points on a border count by overlap.
    A width of at most `parts` stays as it is."""
    if width <= parts:
        return [[(i, 1.0)] for i in range(width)]
    size = width / parts
    out = []
    for k in range(parts):
        lo, hi = k * size, (k + 1) * size
        shares = [(j, max(0.0, min(j + 1, hi) - max(j, lo)) / size) for j in range(int(lo), min(width, math.ceil(hi)))]
        out.append([(j, s) for j, s in shares if s > 1e-12])
    return out


def paa(z: list[Column], parts: int) -> list[Column]:
    """Piecewise aggregate approximation of a window's elements."""
    return [added([v if s == 1.0 else v * s for v, s in ((z[j], s) for j, s in part)]) for part in paa_weights(len(z), parts)]


def dft_values(w: Column, width: int, length: int, sigma: Column, skip: int = 0) -> list[Column]:
    """The first `length` packed Fourier values after `skip` of a window, as words use them.

    Packed order is Re0, (Im0 = 0), Re1, Im1, ...; values are divided by sqrt(width) and sigma (1 if
    that is 0), and every second one changes sign.
    """
    by = math.sqrt(width)
    scale = F.when(sigma == 0, 1.0).otherwise(sigma)
    out = []
    for k in range(skip, skip + length):
        f = k // 2
        if k == 1 or f > width // 2 or (k % 2 and 2 * f == width):
            out.append(zero())
            continue
        angles = [2 * math.pi * ((f * j) % width) / width for j in range(width)]
        factors = [math.cos(a) if k % 2 == 0 else -math.sin(a) for a in angles]
        if width > WIDE:
            s = total(F.zip_with(w, F.array(*map(F.lit, factors)), lambda v, c: v * c))
        else:
            s = added([w[j] * c for j, c in enumerate(factors)])
        sign = -1.0 if (k - skip) % 2 else 1.0
        out.append(s * (sign / by) / scale)
    return out


def power(x: Column, n: int, k: int) -> Column:
    """|DFT_k|^2 of a real series of length n."""
    angles = [2 * math.pi * ((k * j) % n) / n for j in range(n)]
    re = added([x[j] * math.cos(a) for j, a in enumerate(angles)])
    im = added([x[j] * math.sin(a) for j, a in enumerate(angles)])
    return re * re + im * im


def power_packed(x: Column, n: int, k: int) -> Column:
    """|DFT_k|^2 of the n points z_j = x_2j + i x_2j+1, 0 past the end: what a transform gives that
    takes a real series for interleaved complex numbers."""
    re, im = [], []
    for j in range((n + 1) // 2):
        a = 2 * math.pi * ((k * j) % n) / n
        c, s = math.cos(a), math.sin(a)
        re.append(x[2 * j] * c)
        im.append(x[2 * j] * -s)
        if 2 * j + 1 < n:
            re.append(x[2 * j + 1] * s)
            im.append(x[2 * j + 1] * c)
    p, q = added(re), added(im)
    return p * p + q * q


def interval_stats(x: Column, n: int) -> tuple[Column, Column, Column]:
    """Mean, variance and slope over positions of an interval of n values; a flat one has slope 0, and
    a slope of 0 has variance 0."""
    items = [x[i] for i in range(n)]
    mu = added(items) / n
    var = added([v * v for v in items]) / n - mu * mu
    center = (n - 1) / 2
    spread = sum((i - center) ** 2 for i in range(n))
    slope = added([v * (i - center) for i, v in enumerate(items)]) / spread if spread else zero()
    slope = F.when(F.abs(slope) < 1e-12, 0.0).otherwise(slope)
    return mu, F.when(slope == 0, 0.0).otherwise(F.greatest(var, zero())), slope


def same_series(a: Column, b: Column, label_a: Column, label_b: Column) -> Column:
    """Equal in length, values and label."""
    return a.eqNullSafe(b) & label_a.eqNullSafe(label_b)


def subsequence(x: Column, start: int, end: int) -> Column:
    """x[start, end)."""
    return F.slice(x, start + 1, max(end - start, 0))
