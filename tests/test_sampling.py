"""Draws by weight, samples and boosting against plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelode.operators import forest, sampling, splits
from wavelode.operators.candidates import Interval, Words
from wavelode.sources import ranges


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if the ranges were large
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_sums_and_fills_over_ranges(spark, many_ranges):
    rng = np.random.default_rng(0)
    rows = [(int(k), int(v), None if v % 3 else int(v)) for k, v in zip(rng.permutation(300), rng.integers(0, 50, 300), strict=True)]
    df = spark.createDataFrame(rows, "k long, v long, f long")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    got = ranges.numbered(df, "nth", "v", "k")
    assert ranges.in_ranges(df, "v", "k").select("part").distinct().count() > 1
    assert {r.k: r.nth for r in got.collect()} == {r[0]: i for i, r in enumerate(order)}
    sums, total, last, fills = {}, 0, None, {}
    for k, v, f in order:
        sums[k], total = total, total + v
        last = f if f is not None else last
        fills[k] = last
    assert {r.k: r.s for r in ranges.summed_before(df, "s", "v", "v", "k").collect()} == sums
    assert {r.k: r.g for r in ranges.filled(df, "g", "f", "v", "k").collect()} == fills
    assert ranges.numbered(df.limit(0), "nth", "v").count() == 0


def test_draws_by_weight(spark, many_ranges):
    rng = np.random.default_rng(1)
    weights = {i: float(w) for i, w in enumerate(np.round(rng.random(60), 3))} | {60: 0.0, 61: 20.0}
    df = spark.createDataFrame(list(weights.items()), "series_id long, w double")
    got = {r.series_id: r.times for r in sampling.weighted_bootstrap(df, F.col("w"), 400, 7).collect()}
    ends, at = [], 0
    for i, w in sorted(weights.items()):
        at += round(w * sampling.UNITS)
        ends.append((at, i))
    want = Counter()
    for k in range(400):
        u = math.floor((k * 1103515245 + 7) % 2147483648 / 2147483648 * at)
        want[next(i for end, i in ends if u < end)] += 1
    assert got == want and 60 not in got
    assert sampling.weighted_bootstrap(df.where("w = 0"), F.col("w"), 5, 7).count() == 0


def test_samples_are_the_first_in_order(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(700)], "series_id long, label int, node int")
    order = (F.col("series_id") * 48271) % 2147483647
    rank = lambda ids: sorted(ids, key=lambda i: (i * 48271 % 2147483647, i))
    assert sorted(r.series_id for r in sampling.uniform(df, 90, order).collect()) == sorted(rank(range(700))[:90])
    got = {(r.node, r.label): r.ids for r in sampling.smallest(df, 11, order, "node", "label").groupBy("node", "label").agg(F.sort_array(F.collect_list("series_id")).alias("ids")).collect()}
    assert got == {(n, y): sorted(rank([i for i in range(700) if (i % 2, i % 3) == (n, y)])[:11]) for n in range(2) for y in range(3)}
    assert [r.series_id for r in sampling.shuffled(df, order).orderBy("position").collect()] == rank(range(700))


def made(spark, n):
    rng = np.random.default_rng(3)
    t = np.arange(40)
    rows = [(i, i % 3, "train" if i % 4 else "test", [float(v) for v in np.sin(t / (2 + i % 3)) + rng.normal(size=40)]) for i in range(n)]
    return spark.createDataFrame(rows, "series_id long, label int, split string, x array<double>")


def test_a_split_by_sample_is_near_the_best(spark):
    rows = made(spark, 900).withColumn("node", F.lit(0))
    best = splits.gini_splits(splits.attributes(rows, "x", ["node"]), ["node"]).agg(F.min("wgini")).first()[0]
    some = sampling.sampled_splits(rows, ["node"], 60, F.col("series_id") * 48271 % 2147483647).first()
    assert best - 1e-9 <= some.wgini <= best + 0.02
    all_ = sampling.sampled_splits(rows, ["node"], 900, F.col("series_id")).first()
    assert all_.wgini == pytest.approx(best, abs=1e-8) == pytest.approx(all_.sample_wgini, abs=1e-8)


def test_boosting_rounds(spark):
    said = spark.createDataFrame([(0, 1, 1, 2.0), (1, 1, 2, 1.0), (2, 2, 2, 1.0), (3, 2, 2, 4.0)], "series_id long, label int, predicted int, weight double")
    after, error, vote = sampling.reweighted(said, 2)
    assert error == pytest.approx(1 / 8) and vote == pytest.approx(math.log(7))
    got = {r.series_id: r.weight for r in after.collect()}
    assert sum(got.values()) == pytest.approx(4) and got[1] / got[2] == pytest.approx(7) and got[3] / got[0] == pytest.approx(2)
    assert sampling.stage_weight(0.7, 3) == 0
    f = forest.Settings(depth=2, word_tries=1, interval_tries=1, word_params=[Words("SAX", 12, 6), Words("SFA", 16, 6)], intervals=[Interval(0, 32, "ACF")])
    stages, votes = sampling.boosted(made(spark, 120), f, 3)
    stages = stages.orderBy("round").collect()
    assert all(s.error < 2 / 3 for s in stages) and len(stages) <= 3
    assert votes.count() == 120 and votes.where("split = 'test'").count() == 30
    assert votes.where("split = 'train' and label <> predicted").count() < 45
