"""Running sums against every window on its own, words of many parameters at once, and supervised bins against recursion."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelode.functions import kernels as K
from wavelode.functions import sliding, symbols
from wavelode.operators import candidates


def awkward():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(5, 70))
    a[1] = 3.0
    a[2, 10:40] = 2
    a[3] += 1000
    a[4, 20:50] = 1 + 1e-6 * rng.normal(size=30)
    return a


@pytest.mark.parametrize("width", [2, 7, 16, 33, 70])
def test_moments_segments_and_fourier_values_are_those_of_each_window(width):
    a = awkward()
    w = sliding.windows(a, width)
    mu, sd, _ = sliding.moments(a, width)
    assert mu == pytest.approx(w.mean(2), rel=1e-12) and sd == pytest.approx(np.where((w == w[:, :, :1]).all(2), 0, w.std(2)), rel=1e-6, abs=0)
    for parts in (2, 5, 8, 80):
        want = np.stack([sum(w[:, :, j] * s for j, s in part) for part in K.paa_weights(width, parts)], 2)
        assert sliding.paa(a, width, parts) == pytest.approx(want, abs=1e-9)
    for norm_mean in (False, True):
        f = np.fft.rfft(w, axis=2)
        packed = np.stack([f.real, f.imag], 3).reshape(*f.shape[:2], -1)
        packed[:, :, 1] = 0
        if width % 2 == 0:
            packed[:, :, width + 1] = 0
        want = np.zeros((*w.shape[:2], 6))
        part = packed[:, :, 2 * norm_mean :][:, :, :6]
        want[:, :, : part.shape[2]] = part
        want *= np.array([1, -1] * 3) / math.sqrt(width) / np.where(sd == 0, 1, sd)[:, :, None]
        assert sliding.fourier(a, width, 6, norm_mean) == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_windows_of_a_thousand_values(spark):
    x = np.cumsum(np.random.default_rng(3).normal(size=1500))
    rows = symbols.fourier_windows(spark.createDataFrame([(1, [float(v) for v in x])], "series_id long, x array<double>"), 1000, 8).collect()
    assert len(rows) == 501
    w = x[rows[77].offset : rows[77].offset + 1000]
    f = np.fft.rfft(w)
    want = np.stack([f.real, f.imag], 1).ravel()[:8] * np.array([1, -1] * 4) / math.sqrt(1000) / w.std()
    want[1] = 0
    assert rows[77].c == pytest.approx(want, abs=1e-8)


def test_words_of_many_parameters_are_those_of_one_at_a_time(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, "train", [float(v) for v in (np.ones(40) if i == 3 else rng.normal(size=40))]) for i in range(8)] + [(9, 0, "test", [1.0] * 5), (10, 1, "test", None)]
    series = spark.createDataFrame(rows, "series_id long, label int, split string, x array<double>")
    params = [candidates.Words("SAX", 12, 5), candidates.Words("SFA", 14, 6), candidates.Words("SAX", 10, 18), candidates.Words("SFA", 33, 8, 3, True)]
    made = candidates.make_words(series, params).collect()
    usable = series.where("x is not null")
    for k, p in enumerate(params):
        if p.kind == "SAX":
            one = symbols.sax_words(usable, p.width, p.length, p.alphabet)
        else:
            hist = symbols.value_histogram(usable.where("split = 'train'"), p.width, p.length, p.norm_mean)
            one = symbols.sfa_words(usable, symbols.equi_depth_bins(hist, p.alphabet), p.width, p.length, p.alphabet, p.norm_mean)
        assert {(r.series_id, r.offset): r.word for r in made if r.param_id == k} == {(r.series_id, r.offset): r.word for r in one.collect()}


def test_distances_of_packed_words_are_sums_over_letters():
    rng = np.random.default_rng(5)
    for alphabet, length in ((4, 18), (4, 30), (20, 7), (2, 5)):
        words, queries = rng.integers(0, alphabet, (3, 9, length)), rng.integers(0, alphabet, (4, length))
        got = sliding.least_distances(sliding.packed(words, alphabet), sliding.packed(queries, alphabet), cells=10)
        want = np.abs(words[:, :, None, :].astype(int) - queries[None, None]).sum(3).min(1)
        assert (got == want).all()


def recursive_cuts(rows, depth, least=3):
    """rows: (value, label, n)."""
    if not depth:
        return []
    total = Counter()
    for _, label, n in rows:
        total[label] += n

    def impurity(counts):
        n = sum(counts.values())
        return -sum(c / n * math.log2(c / n) for c in counts.values() if c) if n else 0.0

    values, best, left = sorted({v for v, _, _ in rows}), (0.0, None), Counter()
    n = sum(total.values())
    for value, cut in zip(values, values[1:], strict=False):
        for v, label, k in rows:
            if v == value:
                left[label] += k
        nl = sum(left.values())
        if nl >= least and n - nl >= least:
            gain = round(impurity(total) - nl / n * impurity(left) - (n - nl) / n * impurity(total - left), 9)
            if gain > 0 and gain >= best[0]:
                best = (gain, cut)
    if best[1] is None:
        return []
    below, above = [r for r in rows if r[0] < best[1]], [r for r in rows if r[0] >= best[1]]
    return sorted([best[1], *recursive_cuts(below, depth - 1, least), *recursive_cuts(above, depth - 1, least)])


@pytest.mark.parametrize("alphabet", [2, 4, 6, 8])
def test_supervised_bins_against_recursion(spark, alphabet):
    rng = np.random.default_rng(alphabet)
    rows = [(c, float(v), int(y), int(n)) for c in range(4) for v, y, n in zip(rng.integers(0, 25, 60), rng.integers(0, 3, 60), rng.integers(1, 5, 60), strict=True)]
    rows = [(c, v, min(y, int(v > 12)) if c == 2 else y, n) for c, v, y, n in rows] + [(7, 1.0, 0, 9), (8, 1.0, 0, 9), (8, 2.0, 0, 9)]
    hist = spark.createDataFrame(rows, "coef int, value double, label int, n long").groupBy("coef", "value", "label").agg(F.sum("n").alias("n"))
    got = {r.coef: [v for v in r.cuts if v != symbols.UNFILLED] for r in symbols.gain_bins(hist, alphabet).collect()}
    want = {c: recursive_cuts([r[1:] for r in rows if r[0] == c], alphabet.bit_length() - 1) for c in (0, 1, 2, 3, 7, 8)}
    assert got == want
    assert all(len(r.cuts) == alphabet - 1 for r in symbols.gain_bins(hist, alphabet).collect())
