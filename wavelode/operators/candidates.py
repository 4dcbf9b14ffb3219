"""Words and interval attributes of a dataset under a list of parameters, and one-level feature candidates."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectra, symbols
from ..functions.sliding import Words
from ..sources import ranges
from ..sources.storage import stored
from . import splits, words


@dataclass(frozen=True)
class Interval:
    """A [start, end) interval under a filter."""

    start: int
    end: int
    kind: str


    @property
    def attributes(self) -> int:
        """How many values the filter gives."""
        n = self.end - self.start
        lag = spectra.max_lag(n)
        sizes = {"acf": lag, "pacf": lag, "ar": lag, "ps": n, "plain": n // 2 + 1, "dft": 2 * n}
        return sum(sizes[p] for p in spectra.FILTERS[self.kind])


def random_intervals(length: int, count: int, kinds: tuple[str, ...] = ("ACF", "PS"), least: int = 16, seed: int = 7) -> list[Interval]:
    """`count` intervals of at least `least` values between two seeded draws from [0, length), the second
    one not in it; kinds in turn, so that two kinds give every other interval another filter."""
    if length <= least:
        raise ValueError(f"series of {length} values have no interval of {least}")
    rng, out = random.Random(seed), []
    while len(out) < count:
        a, b = sorted((rng.randrange(length), rng.randrange(length)))
        if b - a >= least:
            out.append(Interval(a, b, kinds[len(out) % len(kinds)]))
    return out


def interval_count(candidates: int) -> int:
    """Intervals that a node tries for so many interval candidates: two for every sixteen of a quarter."""
    return 2 * math.ceil(math.ceil(candidates / 4) / 16)


def word_grid(length: int, kind: str, least: int = 10) -> list[Words]:
    """All windows below a series' length with the letters that a kind of word is tried with."""
    letters = range(6, 20, 2) if kind == "SAX" else range(6, 18, 2)
    return [Words(kind, w, p) for w in range(least, length) for p in letters]


def seeded(items: list, seed: int, most: int) -> list:
    """`most` of items in an order that depends on the seed alone."""
    return [x for _, _, x in sorted(((k * 1103515245 + seed * 12345) % 2147483647 * 48271 % 2147483647, k, x) for k, x in enumerate(items))][:most]


def make_words(series: DataFrame, params: list[Words]) -> DataFrame:
    """(param_id, series_id, label, split, offset, word) of all series under all parameters, in one scan; SFA
    bins come from the training split, in one more."""
    cuts = symbols.learned_cuts(series.where("split = 'train'"), params)
    words_ = symbols.parameter_words(series.select("series_id", "label", "split", "x"), params, cuts)
    return words_.select("param_id", "series_id", "label", "split", "offset", "word")


def make_attributes(series: DataFrame, intervals: list[Interval]) -> DataFrame:
    """(param_id, series_id, label, split, attribute, value) of all series."""
    parts = []
    for k, i in enumerate(intervals):
        rows = splits.interval_filter(series, i.start, i.end, i.kind)
        parts.append(splits.attributes(rows, "f", ["split"]).withColumn("param_id", F.lit(k)))
    return reduce(DataFrame.unionByName, parts)


def word_candidates(all_words: DataFrame, series: DataFrame, length: int, top: int, seed: int, alphabet: int = 20) -> DataFrame:
    """(param_id, label, word, origin, offset, gain, threshold): each class's best words, from one
    exemplar per class and measured on the training split."""
    train = all_words.where("split = 'train'")
    chosen = words.exemplars(series.where("split = 'train'"), [], seed).select("series_id")
    own = train.join(chosen, "series_id").groupBy("param_id", "label", "word", F.col("series_id").alias("origin")).agg(F.min("offset").alias("offset"))
    keys = ["label", "word", "origin", "offset"]
    distances = stored(words.min_distances(train, stored(own, "query-words"), length, keys, alphabet), "word-distances")
    scored = words.scored_words(distances, ["param_id", *keys])
    return words.best_words(scored, ["param_id", "label"], top).select("param_id", *keys, "gain", "threshold")


def feature_values(features: DataFrame, all_words: DataFrame, attrs: DataFrame, series: DataFrame, length: int, alphabet: int = 20) -> DataFrame:
    """(split, type, feature_id, series_id, value) of features (feature_id, type, param_id, word, attribute)
    for the series of every split: words' least distances, intervals' attribute values."""
    f = features.where("type <> 'RISE'").select("feature_id", "type", "param_id", "word")
    d = words.min_distances(all_words, f, length, ["feature_id", "type"], alphabet)
    word_values = d.join(series.select("series_id", "split"), "series_id").select("split", "type", "feature_id", "series_id", F.col("value").cast("double").alias("value"))
    g = features.where("type = 'RISE'").select("feature_id", "type", "param_id", "attribute")
    rise_values = attrs.join(g, ["param_id", "attribute"]).select("split", "type", "feature_id", "series_id", "value")
    return word_values.unionByName(rise_values)


def one_level(series: DataFrame, word_params: list[Words], intervals: list[Interval], top: int = 3, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(features, values): candidates of a single node over the whole training split.

    features: feature_id, type, label, infogain, threshold, sign, word, origin, start, window_len,
    attribute, interval_start, interval_end, filter. values: split, type, feature_id, series_id, value.
    """
    all_words = stored(make_words(series, word_params), "words")
    attrs = stored(make_attributes(series, intervals), "attributes")
    longest, alphabet = max((p.length for p in word_params), default=1), max((p.alphabet for p in word_params), default=4)
    w = word_candidates(all_words, series, longest, top, seed, alphabet)
    kinds = F.element_at(F.array(*[F.lit(p.kind) for p in word_params]), F.col("param_id") + 1)
    widths = F.element_at(F.array(*[F.lit(p.width) for p in word_params]), F.col("param_id") + 1)
    word_rows = w.select(
        kinds.alias("type"), "label", F.col("gain").alias("infogain"), F.col("threshold").cast("double").alias("threshold"), F.lit(0).alias("sign"),
        "param_id", "word", "origin", F.col("offset").alias("start"), widths.alias("window_len"),
        F.lit(-1).alias("attribute"), F.lit(-1).alias("interval_start"), F.lit(-1).alias("interval_end"), F.lit("").alias("filter"),
    )
    train = attrs.where("split = 'train'")
    best = splits.gini_splits(train, ["param_id"])
    rise = splits.labelled_by_gain(train, best, ["param_id", "attribute"])
    starts, ends, filters = (
        F.element_at(F.array(*[F.lit(v) for v in vs]), F.col("param_id") + 1)
        for vs in ([i.start for i in intervals], [i.end for i in intervals], [i.kind for i in intervals])
    )
    rise_rows = rise.where("gain > 0").select(
        F.lit("RISE").alias("type"), "label", F.col("gain").alias("infogain"), "threshold", "sign", "param_id",
        F.lit("").alias("word"), F.lit(-1).cast("long").alias("origin"), F.lit(-1).alias("start"), F.lit(-1).alias("window_len"),
        "attribute", starts.alias("interval_start"), ends.alias("interval_end"), filters.alias("filter"),
    )
    rows = word_rows.unionByName(rise_rows)
    rows = ranges.numbered(rows, "feature_id", "type", "param_id", "label", "attribute", "start", "word")
    features = stored(rows.withColumn("feature_id", F.col("feature_id").cast("int")), "features")
    values = feature_values(features, all_words, attrs, series, longest, alphabet)
    return features.drop("param_id"), values
