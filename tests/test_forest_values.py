"""Values of a forest's features are made where series stream past them; what hangs from a node is grown by several tasks."""

import numpy as np
from pyspark.sql import functions as F

from wavelode.functions import sliding, spectra, symbols
from wavelode.operators import filtering, forest, splits
from wavelode.operators.candidates import Interval, Words
from wavelode.plans import catalogue
from wavelode.sources import storage

PARAMS = [Words("SAX", 12, 6), Words("SFA", 12, 6), Words("SFA", 24, 8)]
INTERVALS = [Interval(0, 32, "ACF"), Interval(4, 40, "PS")]


def made(spark, n=90):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 40)) + (np.arange(n) % 3)[:, None] * np.sin(np.arange(40) / 3)
    split = lambda i: "test" if i % 5 == 0 else "validate" if i % 5 == 1 else "train"
    return x, spark.createDataFrame([(i, i % 3, split(i), [float(v) for v in x[i]]) for i in range(n)], "series_id long, label int, split string, x array<double>")


def test_values_are_those_of_brute_force_without_a_table_of_words(spark):
    x, series = made(spark)
    f = forest.grow(series, forest.Settings(trees=1, word_tries=2, interval_tries=2, word_params=PARAMS, intervals=INTERVALS))
    features = forest.export(f).select("feature_id", "type", "param_id", "word", "attribute")
    more = features.agg(F.max("feature_id").alias("m")).first().m + 1
    both = features.unionByName(spark.createDataFrame([(more + k, "RISE", k, "", 3 + k) for k in range(2)], features.schema))
    both = spark.createDataFrame(both.collect(), both.schema)
    want = {}
    for r in both.collect():
        if r.type == "RISE":
            i = INTERVALS[r.param_id]
            v = np.round(spectra.filter_values(x[:, i.start : i.end], i.kind), 6)[:, r.attribute]
        else:
            p = PARAMS[r.param_id]
            letters = sliding.letters(x, p, f.cuts[r.param_id]).astype(int)
            v = np.abs(letters - (np.frombuffer(r.word.encode(), np.uint8).astype(int) - 97)).sum(2).min(1)
        want |= {(r.feature_id, i): float(v[i]) for i in range(len(x))}
    for block in (16_384, 2, 1):  # few blocks; more of them than parameters
        token = storage.WRITTEN.set([])
        try:
            rows = forest.export_values(f, both, block=block).collect()
            assert storage.WRITTEN.get() == []
        finally:
            storage.WRITTEN.reset(token)
        assert len(rows) == len(want) and {(r.feature_id, r.series_id): r.value for r in rows} == want
    some = forest.export_values(f, both, ("validate",)).select("split", "series_id").distinct().collect()
    assert {r.split for r in some} == {"validate"} and len(some) == 18


def test_parts_of_a_node_grown_by_other_tasks_are_the_same(spark):
    _, series = made(spark)
    settings = lambda **more: forest.Settings(trees=2, word_tries=2, interval_tries=1, word_params=PARAMS, intervals=INTERVALS, **more)
    whole, parts = forest.grow(series, settings()), forest.grow(series, settings(part_rows=12))
    for name in ("nodes", "rules"):
        a, b = (sorted(map(str, getattr(g, name).collect())) for g in (whole, parts))
        assert a == b and a


def test_counted_histograms_are_those_of_all_values(spark):
    x, series = made(spark)
    p = Words("SFA", 12, 6)
    got = {(r.label, r.coef, r.value): r.n for r in symbols.value_histograms(series, [p], "label").collect()}
    want = {}
    c = sliding.rounded(sliding.fourier(x, 12, 6)[:, ::12])
    for i in range(len(x)):
        for block in c[i]:
            for k, v in enumerate(block):
                want[i % 3, k, float(v)] = want.get((i % 3, k, float(v)), 0) + 1
    assert got == want


def test_distances_of_many_rows_and_of_few(spark):
    rng = np.random.default_rng(0)
    for rows in (3, 200, 1100):
        a, q = rng.integers(0, 5, (rows, 7, 30)), rng.integers(0, 5, (11, 30))
        want = np.abs(a[:, :, None] - q[None, None]).sum(3).min(1)
        assert (sliding.least_distances(sliding.packed(a, 5), sliding.packed(q, 5)) == want).all()


def test_splits_in_a_task_are_those_of_the_expressions(spark):
    rng = np.random.default_rng(6)
    rows = [(k, a, float(np.round(rng.normal(), 1)) if a else 3.0, int(rng.integers(0, 4)), int(rng.integers(1, 3))) for k in range(2) for a in range(4) for _ in range(80)]
    df = spark.createDataFrame(rows, "k int, attribute int, value double, label int, n long")
    got, want = ({(r.k, r.attribute): (r.threshold, r.wgini) for r in f(df, ["k"], "n").collect()} for f in (splits.task_gini_splits, splits.small_gini_splits))
    assert got == want and len(got) == 6


def test_a_large_nodes_rows_are_dealt_over_tasks(spark, monkeypatch):
    _, series = made(spark)
    seen = []
    real = forest.histograms
    monkeypatch.setattr(forest, "histograms", lambda heads, members, f, cuts: seen.append((f.salt_rows, members.select("salt").distinct().count())) or real(heads, members, f, cuts))
    many = series.crossJoin(spark.range(40)).select((F.col("series_id") + 100 * F.col("id")).alias("series_id"), "label", "split", "x")
    f = forest.grow(many, forest.Settings(trees=4, word_tries=1, interval_tries=1, depth=1, task_rows=1000, word_params=PARAMS[:1], intervals=INTERVALS[:1]))
    assert seen == [(1080, 2)]  # 4 * 2160 rows over 2 * 4 tasks
    assert f.nodes.where("node_id = 'r' and n = 2160").count() == 4


def test_accuracy_asks_for_the_splits_it_reads_and_is_that_of_all_values(spark, small, monkeypatch):
    monkeypatch.setattr(catalogue, "FOREST", forest.Settings.pooled(64, words=4, intervals=4, tries=(1, 1), trees=1))
    real, seen, grown = forest.export_values, [], []
    grow = catalogue._forest_features
    monkeypatch.setattr(catalogue, "_forest_features", lambda s, d: grown.append(grow(s, d)) or grown[-1])
    monkeypatch.setattr(forest, "export_values", lambda f, features, splits_=None, **more: seen.append(splits_) or real(f, features, splits_, **more))
    got = catalogue.forest_test_accuracy(spark, small).first()
    assert seen == [("validate",), ("validate", "test")]
    f, features = grown[0]
    values = storage.stored(real(f, features), "all-values")
    acc = filtering.prefix_accuracy(features, values.where("split = 'validate'"), catalogue._split(spark, small, "validate"))
    n, _ = filtering.choose(storage.stored(acc, "accuracies"), features.count())
    some, theirs = filtering.top_features(features, n), filtering.top_values(features, values, n)
    clusters = catalogue._clusters(spark, small, some.drop("rank"), theirs)
    want = catalogue._test_accuracy(spark, small, *catalogue._search(spark, small, some, theirs, clusters)).first()
    assert (got.n_filtered, got.accuracy, got.n_features) == (n, want.accuracy, want.n_features)
