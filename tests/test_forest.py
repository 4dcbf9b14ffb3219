"""A forest grown over tasks, in tasks, and both: three ways to the same nodes and rules; its splits against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelode.operators import forest, impurity, splits
from wavelode.operators.candidates import Interval, Words

SCHEMA = "series_id long, label int, split string, x array<double>"


def made(spark, n, classes=3, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(40)
    rows = []
    for i in range(n):
        y = i % classes
        x = np.sin(t / (2 + y)) * (rng.random() + 0.5) + rng.normal(size=40) * 0.7
        rows.append((i, y, "test" if i % 5 == 0 else "train", [float(v) for v in (np.ones(40) if i == 7 else x)]))
    return spark.createDataFrame(rows, SCHEMA)


PARAMS = [Words("SAX", 12, 6), Words("SFA", 12, 6), Words("SAX", 20, 8), Words("SFA", 24, 8, 4, True)]
INTERVALS = [Interval(0, 32, "ACF"), Interval(4, 40, "PS"), Interval(2, 30, "ACF_PACF_ARMA")]


def settings(**more):
    return forest.Settings(trees=2, word_params=PARAMS, intervals=INTERVALS, **{"word_tries": 2, "interval_tries": 2, **more})


def rows_of(df):
    out = []
    for r in df.collect():
        out.append(tuple(round(v, 6) if isinstance(v, float) else v for v in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("more", [{}, {"full_split": True, "min_leaf": 4}, {"depth": 2, "words_tried": 5}])
def test_growing_in_tasks_or_over_them_gives_the_same_forest(spark, more):
    series = made(spark, 100)
    one = forest.grow(series, settings(**more))
    for sizes in ({"task_rows": 0, "salt_rows": 15}, {"task_rows": 30, "salt_rows": 1000}):
        other = forest.grow(series, settings(**more, **sizes))
        assert rows_of(other.nodes) == rows_of(one.nodes)
        assert rows_of(other.rules) == rows_of(one.rules)
    assert one.rules.count() > 0
    train = forest.predict(one, "train")
    if not more:
        assert train.where("label <> predicted").count() == 0  # grown to purity
        leaves = one.nodes.where("leaf")
        assert leaves.where("gini > 0").count() == 0 and leaves.groupBy("tree_id").agg(F.sum("n").alias("n")).where("n <> 80").count() == 0
    assert forest.predict(one, "test").count() == 2 * 20


def test_in_task_choices_are_those_of_the_expressions(spark):
    rng = np.random.default_rng(2)
    n, labels = 60, rng.integers(0, 3, 60)
    x = rng.normal(size=(n, 40)) + labels[:, None] * np.sin(np.arange(40) / 3)
    f = settings()
    series = spark.createDataFrame([(i, int(labels[i]), "train", [float(v) for v in x[i]]) for i in range(n)], SCHEMA)
    node = forest.Node(f, forest.symbols.learned_cuts(series, PARAMS), 0, "r")
    names, y = np.unique(labels, return_inverse=True)
    (rule,) = forest.value_entries(node, 1, names, y, x)
    values = node.values(node.interval_param(1), x)[:, node.attributes(1)]
    long = spark.createDataFrame([(int(a), float(values[i, k]), int(labels[i])) for i in range(n) for k, a in enumerate(node.attributes(1))], "attribute int, value double, label int").withColumn("k", F.lit(0))
    for found in (splits.gini_splits(long, ["k"]), splits.small_gini_splits(long.withColumn("c", F.lit(1)), ["k"], "c")):
        best = found.orderBy("wgini", "attribute").first()
        assert (best.attribute, round(best.threshold, 9)) == (rule["attribute"], round(rule["threshold"], 9))
    for e in forest.word_entries(node, 0, names, y, np.arange(n), x):
        p = PARAMS[e["param"]]
        code = forest.sliding.packed(np.frombuffer(e["word"].encode(), np.uint8)[None] - 97, p.alphabet)
        d = forest.sliding.least_distances(node.codes(e["param"], x), code)[:, 0]
        rows = spark.createDataFrame([(0, int(v), int(c)) for v, c in zip(d, labels, strict=True)], "k int, value int, label int")
        want = impurity.best_thresholds(rows, ["k"], F.col("label") == e["label"]).first()
        assert (e["gain"], e["threshold"]) == (pytest.approx(want.gain), want.threshold)
        assert d[e["origin"]] == 0


def test_range_splits_are_those_of_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(k, a, float(np.round(rng.normal(), 1)) if a else 3.0, int(rng.integers(0, 4))) for k in range(2) for a in range(4) for _ in range(80)]
    df = spark.createDataFrame(rows, "k int, attribute int, value double, label int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if the ranges were large
    try:
        got = {(r.k, r.attribute): (r.threshold, r.wgini) for r in splits.gini_splits(df, ["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    def gini(labels):
        return 1 - sum((c / len(labels)) ** 2 for c in Counter(labels).values())

    want = {}
    for k in range(2):
        for a in range(1, 4):
            own = [(v, y) for kk, aa, v, y in rows if (kk, aa) == (k, a)]
            values = sorted({v for v, _ in own})
            options = []
            for v, following in zip(values, values[1:], strict=False):
                low, high = [y for u, y in own if u <= v], [y for u, y in own if u > v]
                options.append((round((len(low) * gini(low) + len(high) * gini(high)) / len(own), 9), (v + following) / 2))
            want[k, a] = min(options)[::-1]
    assert {k: (round(t, 9), g) for k, (t, g) in got.items()} == {k: (round(t, 9), g) for k, (t, g) in want.items()}


def test_a_forest_of_one_class_and_of_constant_series(spark):
    same = made(spark, 10, classes=1)
    f = forest.grow(same, settings())
    assert f.rules.count() == 0 and f.nodes.where("leaf and gini = 0").count() == 2
    assert {r.predicted for r in forest.predict(f, "test").collect()} == {0}
    flat = spark.createDataFrame([(i, i % 2, "train", [1.0] * 40) for i in range(9)], SCHEMA)
    for sizes in ({}, {"task_rows": 0}):
        assert forest.grow(flat, settings(**sizes)).nodes.select("leaf", "n", "label").distinct().collect() == [(True, 9, 0)]
