"""Ensembles of word models and running accuracies against plain loops."""

import math
from collections import Counter, defaultdict

import numpy as np

from wavelode.operators import ensemble, filtering


def test_models_tell_classes_apart_and_equal_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = []
    for param in range(2):
        for series in range(40):
            label = series % 3
            own = rng.choice(["aa", "bb", "cc", "dd"], 30, p=np.roll([0.7, 0.1, 0.1, 0.1], label))
            rows += [(param, series, label, "train" if series < 24 else "test", str(w)) for w in own]
    words = spark.createDataFrame(rows, "param_id int, series_id long, label int, split string, word string")
    vectors = ensemble.class_vectors(words.where("split = 'train'"))
    found = {(r.param_id, r.series_id): r.predicted for r in ensemble.predictions(words.where("split = 'test'"), vectors).collect()}
    tf = Counter((p, y, w) for p, _, y, split, w in rows if split == "train")
    holders = defaultdict(set)
    for p, y, w in tf:
        holders[p, w].add(y)
    weight = {k: (1 + math.log(n)) * math.log(1 + 3 / len(holders[k[0], k[2]])) for k, n in tf.items()}
    length = defaultdict(float)
    for (p, y, _), v in weight.items():
        length[p, y] += v * v
    want = {}
    for p in range(2):
        for s in range(24, 40):
            bag = Counter(w for q, t, _, _, w in rows if (q, t) == (p, s))
            want[p, s] = max((round(sum(n * weight.get((p, y, w), 0) for w, n in bag.items()) / math.sqrt(length[p, y]), 9), y) for y in range(3))[1]
    assert found == want
    assert np.mean([y == s % 3 for (_, s), y in found.items()]) > 0.9


def test_models_by_factor_and_their_vote(spark):
    predicted = spark.createDataFrame(
        [(0, 1, 5), (1, 1, 3), (2, 1, 3), (0, 2, 4), (1, 2, 9), (3, 2, 1), (2, 3, None), (0, 4, 2), (2, 4, 8)], "param_id int, series_id long, predicted int"
    )
    series = spark.createDataFrame([(1, 3), (2, 4), (3, 0), (4, 8)], "series_id long, label int")
    results = {r.param_id: r.correct for r in ensemble.results(predicted, series, 5).collect()}
    assert results == {0: 1, 1: 1, 2: 2, 3: 0, 4: 0}
    models = spark.createDataFrame([(0, 100), (1, 92), (2, 92), (3, 91)], "param_id int, correct long")
    kept = ensemble.by_factor(models)
    assert sorted(r.param_id for r in kept.collect()) == [0, 1, 2]
    votes = {r.series_id: (r.predicted, r.weight, r.n_models) for r in ensemble.vote(predicted, kept).collect()}
    assert votes == {1: (3, 184, 3), 2: (4, 100, 2), 4: (2, 100, 2)}
    plain = {r.series_id: (r.predicted, r.weight) for r in ensemble.vote(predicted, kept, weighted=False).collect()}
    assert plain == {1: (3, 2), 2: (9, 1), 4: (8, 1)}  # the larger label of two with a vote each
    nothing = predicted.where("false")
    assert ensemble.vote(nothing, kept).count() == 0
    assert [r.correct for r in ensemble.results(nothing, series, 2).collect()] == [0, 0]


def test_prefix_accuracy_equals_a_plain_loop(spark):
    rng = np.random.default_rng(8)
    features = [(k, k + 1, "SAX", int(rng.integers(0, 3)), float(np.round(rng.random(), 2)), 0.5, 1) for k in range(23)]
    values = [(k, s, "SAX", float(rng.random())) for k in range(23) for s in range(30) if s != 7]  # a series without any vote
    series = [(s, int(rng.integers(0, 4))) for s in range(30)]  # label 3 has no feature
    table = spark.createDataFrame(features, "feature_id long, rank int, type string, label int, infogain double, threshold double, sign int")
    for against in (True, False):
        found = {r.n: r.accuracy for r in filtering.prefix_accuracy(
            table, spark.createDataFrame(values, "feature_id long, series_id long, type string, value double"),
            spark.createDataFrame(series, "series_id long, label int"), 5, against).collect()}
        want = {}
        for n in range(5, 23, 5):
            hits = 0
            for s, truth in series:
                score = dict.fromkeys(range(3), 0.0)
                for k, t, _, v in values:
                    if t == s and k < n:
                        _, _, _, y, gain, at, _ = features[k]
                        score[y] += gain if v < at else -gain if against else 0.0
                tops = [y for y in score if round(score[y], 9) == max(round(x, 9) for x in score.values())]
                hits += tops == [truth]
            want[n] = hits / len(series)
        assert found.keys() == want.keys() and all(abs(found[n] - want[n]) < 1e-12 for n in want)
    few = table.where("rank <= 5")
    assert filtering.prefix_accuracy(few, spark.createDataFrame(values, "feature_id long, series_id long, type string, value double"), spark.createDataFrame(series, "series_id long, label int")).count() == 0
