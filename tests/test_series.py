"""Kernels against hand-made vectors, and whole queries against their DuckDB twins."""

import math
import os
import shutil
import subprocess
import sys
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelode.functions import kernels as K
from wavelode.functions import spectra, symbols
from wavelode.operators import candidates, clustering, filtering, forest, impurity, splits
from wavelode.plans import catalogue, oracle
from wavelode.sources import series as S

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, x, **more):
    return spark.createDataFrame([(1, 0, "train", [float(v) for v in x])], "series_id long, label int, split string, x array<double>")


def test_dft_of_a_known_vector(spark):
    x = [5, 1, -2, 0.5, 7, 3, -1, 4]
    got = np.array(one(spark, x).select(spectra.power_spectrum("x").alias("p")).first().p)
    assert got == pytest.approx(np.abs(np.fft.rfft(x)) ** 2)
    packed = np.array(one(spark, x).select(spectra.power_spectrum_packed("x").alias("p")).first().p)
    z = np.array(x[::2]) + 1j * np.array(x[1::2])
    assert packed == pytest.approx(np.abs(np.fft.fft(z, 8)) ** 2)


def test_window_dft_values_are_those_of_numpy(spark):
    x = np.random.default_rng(0).normal(size=40)
    rows = symbols.fourier_windows(one(spark, x), 16, 8).collect()
    assert len(rows) == 40 - 16 + 1
    for r in rows:
        w = x[r.offset : r.offset + 16]
        f = np.fft.rfft(w)
        packed = np.stack([f.real, f.imag], 1).ravel()[:8]
        packed[1] = 0
        assert r.c == pytest.approx(packed / 4 / w.std() * np.array([1, -1] * 4), abs=1e-9)


def test_sax_ties_and_flat_windows(spark):
    assert symbols.gaussian_cuts(4) == pytest.approx([-0.6744898, 0, 0.6744898], abs=1e-6)
    row = spark.range(1).select(symbols.letter(F.lit(0.0), symbols.gaussian_cuts(4)).alias("c")).first()
    assert row.c == "c"
    words = [r.word for r in symbols.sax_words(one(spark, [5.0] * 20), 16, 8).collect()]
    assert words == ["c" * 8] * 5
    with pytest.raises(ValueError):
        symbols.gaussian_cuts(1)


def test_paa(spark):
    z = [F.lit(float(v)) for v in range(1, 6)]
    assert spark.range(1).select(F.array(*K.paa(z, 2)).alias("p")).first().p == pytest.approx([1.8, 4.2])
    assert spark.range(1).select(F.array(*K.paa(z, 9)).alias("p")).first().p == [1, 2, 3, 4, 5]


def test_equi_depth_bins(spark):
    rows = [(0, float(v), 1) for v in range(1, 9)] + [(1, 0.0, 8)]
    got = {r.coef: r.cuts for r in symbols.equi_depth_bins(spark.createDataFrame(rows, "coef int, value double, n long")).collect()}
    assert got[0] == [3, 5, 7] and got[1] == [0.0, symbols.UNFILLED, symbols.UNFILLED]


def test_information_gain(spark):
    rows = spark.createDataFrame([(0, d, y) for d, y in ((0, 1), (0, 1), (3, 2), (3, 2))], "k int, value int, label int")
    got = impurity.best_thresholds(rows, ["k"], F.col("label") == 1).first()
    assert got.gain == pytest.approx(math.log(2), abs=1e-6) and got.threshold == 3
    flat = impurity.best_thresholds(rows.withColumn("value", F.lit(1)), ["k"], F.col("label") == 1).first()
    assert (flat.gain, flat.threshold) == (0, 0)


def test_autocorrelations_and_recursion():
    x = np.random.default_rng(1).normal(size=(3, 50))
    r = spectra.autocorrelations(x, 60)
    for lag in (1, 7, 40):
        assert r[0, lag - 1] == pytest.approx(np.corrcoef(x[0, :-lag], x[0, lag:])[0, 1])
    assert (r[:, 49:] == 0).all() and (spectra.autocorrelations(np.ones((1, 9)), 4) == 0).all()
    rho = 0.6 ** np.arange(1, 6)[None]
    partial, coefficients = spectra.durbin_levinson(rho)
    assert partial[0] == pytest.approx([0.6, 0, 0, 0, 0], abs=1e-12) and coefficients[0] == pytest.approx([0.6, 0, 0, 0, 0], abs=1e-12)
    assert spectra.orders(rho, 100).tolist() == [1]


@pytest.mark.parametrize("kind", list(spectra.FILTERS))
def test_every_filter_gives_values(spark, kind):
    x = np.random.default_rng(2).normal(size=40)
    f = splits.interval_filter(one(spark, x), 2, 34, kind).first().f
    assert len(f) >= 16 and np.isfinite(f).all()


def test_attribute_budget_and_grid():
    assert splits.attribute_budget(100, "sqrt") == 10 and splits.attribute_budget(8, 0) == 8 and splits.attribute_budget(8, 99) == 8
    grid = candidates.word_grid(24, "SAX")
    assert len(grid) == 14 * 7 and candidates.seeded(grid, 1, 5) == candidates.seeded(grid, 1, 5) != candidates.seeded(grid, 2, 5)


def test_readers_and_writers(spark, tmp_path):
    lines = [f"{label}\t" + "\t".join(str(v) for v in row) for label, row in ((1.0, [1, 2.5, 3]), (2, [4, 5, 6]))]
    (tmp_path / "a.tsv").write_text("\n".join(lines) + "\n\n")
    rows = S.read_series(spark, str(tmp_path / "a.tsv")).orderBy("series_id").collect()
    assert [(r.label, r.x) for r in rows] == [(1, [1, 2.5, 3]), (2, [4, 5, 6])]
    (tmp_path / "b.arff").write_text("% note\n@relation r\n@attribute a numeric\n@data\n1,2,1\n-3,4,2\n")
    rows = S.read_series(spark, str(tmp_path / "b.arff")).orderBy("series_id").collect()
    assert [(r.label, r.x) for r in rows] == [(1, [1, 2]), (2, [-3, 4])]
    (tmp_path / "c.csv").write_text("label,a\n1,7\n")
    assert S.read_delimited(spark, str(tmp_path / "c.csv"), ",", header=True).first().x == [7]
    shape = S.shape(S.read_series(spark, str(tmp_path / "a.tsv"))).first()
    assert (shape.n_rows, shape.length) == (2, 3)
    values = spark.createDataFrame([("test", "SAX", 1, 2, 0.5), ("test", "SAX", 1, 1, 0.25)], "split string, type string, feature_id int, series_id long, value double")
    S.write_values(values, str(tmp_path / "values"))
    assert spark.read.parquet(str(tmp_path / "values")).count() == 2
    assert S.wide_values(values).first().line == "1,0.25,0.5"
    features = spark.createDataFrame([(1, "SAX", 2), (2, "RISE", 1)], "feature_id int, type string, label int")
    S.write_features(features, str(tmp_path / "features"))
    back = S.read_features(spark, str(tmp_path / "features"), features.schema)
    assert sorted(map(tuple, back.collect())) == [(1, "SAX", 2), (2, "RISE", 1)]


def test_wide_values_are_read_as_they_were_written(spark, tmp_path):
    values = spark.createDataFrame([(f, i, f + i / 7) for f in (3, 4) for i in range(10)], "feature_id int, series_id long, value double")
    (tmp_path / "wide.csv").write_text("\n".join(r.line for r in S.wide_values(values).collect()) + "\n\n")
    (tmp_path / "none.csv").write_text("")
    series = values.select("series_id").distinct()
    for name, n in (("wide.csv", 20), ("none.csv", 0)):
        got = S.read_wide_values(spark, str(tmp_path / name), series).collect()
        assert len(got) == n and all(r.value == pytest.approx(r.feature_id + r.series_id / 7) for r in got)
    chunks = S.wide_values(values, 4).orderBy("feature_id", "chunk").collect()
    assert [len(r.line.split(",")) - 1 for r in chunks] == [4, 4, 2] * 2


def test_outcomes_are_written(spark, tmp_path):
    features = spark.createDataFrame([(1, "SAX", 2)], "feature_id int, type string, label int")
    values = spark.createDataFrame([("test", "SAX", 1, 2, 0.5)], "split string, type string, feature_id int, series_id long, value double")
    S.write_filtered(features, values, spark.createDataFrame([(5, 0.5)], "n int, accuracy double"), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f/values")).first().value == 0.5
    assert spark.read.csv(str(tmp_path / "f/accuracies")).first()._c1 == "0.5"
    clusters = spark.createDataFrame([("SAX_1", 1, 0, 1, 2, 3, 0.25)], "group_id string, k int, cluster_id int, centroid_feature_id int, label int, size int, weight double")
    S.write_clusters(clusters, spark.createDataFrame([(0.75, 1)], "accuracy double, n int"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c/clusters")).first().group_id == "SAX_1" and spark.read.csv(str(tmp_path / "c/accuracy")).first()._c0 == "0.75"


def test_archive_and_odd_arff_lines(spark, tmp_path):
    (tmp_path / "Pipes").mkdir()
    (tmp_path / "Pipes/Pipes_TRAIN.txt").write_text("1,2,3\n2,4,5\n")
    assert sorted((r.label, r.x) for r in S.read_archive(spark, str(tmp_path), "Pipes").collect()) == [(1, [2, 3]), (2, [4, 5])]
    (tmp_path / "odd.arff").write_text("% x\n@relation r\n@DATA\n?,2,1\nNaN,4,2\n")
    rows = S.read_series(spark, str(tmp_path / "odd.arff")).orderBy("series_id").collect()
    assert rows[0].x == [None, 2] and math.isnan(rows[1].x[0]) and [r.label for r in rows] == [1, 2]


def test_linkage_and_sliding_distance(spark):
    d = np.array([[0, 1, 9], [1, 0, 2], [9, 2, 0]], float)
    assert clustering.agglomerated(d)[2] == [[0, 1], [2]]
    row = spark.range(1).select(clustering.sliding_distance(F.array(F.lit(1.0), F.lit(2.0)), F.array(*map(F.lit, (9.0, 1.0, 2.0, 7.0)))).alias("d")).first()
    assert row.d == 0


def test_word_codes_give_letter_distances(spark):
    rng = np.random.default_rng(3)
    for alphabet, length in ((4, 8), (4, 18), (20, 5), (20, 18), (2, 7)):
        words = ["".join(chr(97 + c) for c in rng.integers(0, alphabet, length)) for _ in range(40)]
        rows = spark.createDataFrame(list(zip(words, words[1:], strict=False)), "a string, b string")
        d = symbols.word_l1(symbols.word_code(F.col("a"), length, alphabet), symbols.word_code(F.col("b"), length, alphabet), length, alphabet)
        least = symbols.least_l1(symbols.word_code(F.col("a"), length, alphabet), F.array(*[symbols.word_code(F.lit(w), length, alphabet) for w in words[:5]]), length, alphabet)
        far = lambda a, b: sum(abs(ord(x) - ord(y)) for x, y in zip(a, b, strict=True))
        for a, b, got, nearest in rows.select("a", "b", d, least).collect():
            assert got == far(a, b) and nearest == min(far(a, w) for w in words[:5])


def test_random_intervals_and_pools():
    some = candidates.random_intervals(64, 40, seed=3)
    assert some == candidates.random_intervals(64, 40, seed=3) != candidates.random_intervals(64, 40, seed=4)
    assert all(0 <= i.start < i.end < 64 and i.end - i.start >= 16 for i in some) and [i.kind for i in some[:4]] == ["ACF", "PS", "ACF", "PS"]
    assert candidates.interval_count(100) == 4
    with pytest.raises(ValueError):
        candidates.random_intervals(16, 1)
    pool = forest.Settings.pooled(64)
    assert len(pool.word_params) == 54 * 13 and len(pool.intervals) == 100 and pool.word_tries == 200  # the whole grid, under 1000


def clustered(spark):
    """Features of two groups, with the distances worked out by hand in the test."""
    base = dict(threshold=0.0, sign=0, origin=0, start=0, window_len=4)
    rows = [
        dict(base, feature_id=k, type="RISE", label=1, infogain=g, word="", attribute=a, interval_start=s, interval_end=s + 20, filter="PS", sub=None)
        for k, (g, a, s) in enumerate([(0.9, 0, 0), (0.8, 1, 0), (0.7, 9, 30), (0.6, 8, 30), (0.5, 2, 1), (0.4, 9, 31)])
    ]
    rows += [dict(base, feature_id=10 + k, type="SAX", label=2, infogain=0.5 - k / 10, word="ab", attribute=-1, interval_start=-1, interval_end=-1, filter="", sub=s) for k, s in enumerate([[0.0, 1.0, 0.0], [0.1, 1.0], [5.0, 9.0]])]
    names = list(rows[0])
    kinds = "threshold double, sign int, origin long, start int, window_len int, feature_id int, type string, label int, infogain double, word string, attribute int, interval_start int, interval_end int, filter string, sub array<double>"
    return clustering.groups(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], kinds))


def brute_clusters(rows, far, merit):
    """Seed linkage with lists; clusters of every k up to 5."""
    groups, out = [[i] for i in range(len(rows))], {}
    while groups:
        if len(groups) <= 5:
            out[len(groups)] = [list(g) for g in groups]
        if len(groups) == 1:
            return out
        _, i, j = min((far[groups[i][0]][groups[j][0]], i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[i] += groups.pop(j)
    return out


def test_clusters_equal_brute_force(spark):
    features = clustered(spark)
    acc = spark.createDataFrame([(k, 0.5 + k % 3 / 10) for k in (0, 1, 2, 3, 4, 5, 10, 11, 12)], "feature_id int, accuracy double")
    got = {(r.group_id, r.k, r.cluster_id): (r.centroid_feature_id, r.size, round(r.weight, 9)) for r in clustering.cluster(features, acc).collect()}
    want = {}
    for group in ("PS_1", "SAX_2"):
        rows = sorted((r for r in features.collect() if r.group_id == group), key=lambda r: (-r.infogain, r.word, r.feature_id))

        def far(a, b):
            if a.type == "RISE":
                return abs(a.attribute - b.attribute) + abs(a.interval_start - b.interval_start) + abs(a.interval_end - b.interval_end)
            x, y = sorted((a["sub"], b["sub"]), key=len)
            return min(math.sqrt(sum((p - q) ** 2 for p, q in zip(x, y[o:], strict=False)) / len(x)) for o in range(len(y) - len(x) + 1))

        merit = [r.infogain * (0.5 + r.feature_id % 3 / 10) for r in rows]
        for k, groups in brute_clusters(rows, [[far(a, b) for b in rows] for a in rows], merit).items():
            for c, members in enumerate(groups):
                top = max(members, key=lambda m: (merit[m], -members.index(m)))
                want[group, k, c] = (rows[top].feature_id, len(members), round(rows[top].infogain * math.log(len(members) + 1), 9))
    assert got == want


@pytest.mark.parametrize("linkage", ["seed", "complete"])
def test_merging_by_nearest_neighbours_equals_lists(linkage):
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 9, 30):
        d = rng.integers(0, 6, (n, n)).astype(float)
        d = np.triu(d, 1) + np.triu(d, 1).T
        groups, want = [[i] for i in range(n)], {}
        while groups:
            if len(groups) <= 5:
                want[len(groups)] = [list(g) for g in groups]
            if len(groups) == 1:
                break
            far = lambda a, b: d[a[0], b[0]] if linkage == "seed" else d[np.ix_(a, b)].max()  # noqa: B023, E731
            _, i, j = min((far(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
            groups[i] += groups.pop(j)
        assert clustering.agglomerated(d, linkage) == want


def test_clusters_of_five_thousand_features(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "SAX", 1, float(rng.random()), "abcd", -1, -1, -1, 12, [float(v) for v in rng.normal(size=12)], "SAX_1") for i in range(5000)]
    kinds = "feature_id int, type string, label int, infogain double, word string, attribute int, interval_start int, interval_end int, window_len int, sub array<double>, group_id string"
    features = spark.createDataFrame(rows, kinds)
    began = time.time()
    got = clustering.cluster(features, features.select("feature_id", F.lit(0.5).alias("accuracy"))).collect()
    assert time.time() - began < 60 and sum(r.size for r in got) == 5 * 5000


def test_greedy_search_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    groups, labels = ["A_1", "A_2", "B_1"], {i: int(rng.integers(1, 3)) for i in range(30)}
    cube = {(g, k, i, y): float(rng.normal()) for g in groups for k in range(1, 6) for i in labels for y in (1, 2)}
    sizes = {"A_1": 7, "A_2": 2, "B_1": 5}

    def accuracy(vector):
        total = {(i, y): round(sum(cube[g, vector[g], i, y] for g in groups), 9) for i in labels for y in (1, 2)}
        return sum((1 if total[i, 1] >= total[i, 2] else 2) == y for i, y in labels.items()) / len(labels)

    k, best = dict.fromkeys(groups, 1), accuracy(dict.fromkeys(groups, 1))
    while open_ := [g for g in groups if k[g] < min(5, sizes[g])]:
        trials = [accuracy({**k, g: k[g] + 1}) for g in open_]
        if max(trials) < best:
            break
        k[open_[trials.index(max(trials))]] += 1
        best = max(trials)
    table = spark.createDataFrame([(*key, v) for key, v in cube.items()], "group_id string, k int, series_id int, label int, score double")
    got, reached = clustering.greedy_k(table, sizes, spark.createDataFrame(list(labels.items()), "series_id int, label int"))
    assert got == k and reached == pytest.approx(best)


def test_medians_lags_and_parameter_files(spark, tmp_path):
    rows = spark.createDataFrame([([3.0, 1.0, 2.0],), ([4.0, 1.0, 2.0, 9.0],), ([],)], "x array<double>")
    assert [r.m for r in rows.select(K.median(F.col("x")).alias("m")).collect()] == [2, 3, None]
    assert [spectra.series_lag(n) for n in (64, 30, 1000, 3)] == [16, 26, 100, 3]
    (tmp_path / "p.csv").write_text("Pipes,TRUE,24,8\nName,Norm,Window,Letters\n\nLocks,false,10,16,0.9\n")
    got = S.read_word_parameters(spark, str(tmp_path / "p.csv")).orderBy("dataset").collect()
    assert list(map(tuple, got)) == [("Locks", False, 10, 16, 4), ("Pipes", True, 24, 8, 4)]


def test_choice_of_prefix(spark):
    acc = spark.createDataFrame([(5, 0.8), (10, 0.9), (15, 0.7), (20, 0.9), (40, 0.9)], "n int, accuracy double")
    assert [filtering.choose(acc, 100, m)[0] for m in (1, 2, 3)] == [10, 40, 20]
    assert filtering.choose(acc.where("n > 99"), 4) == (5, 0.0)


def test_forest_invariants(spark, small):
    rows = catalogue.data(spark, small).where("series_id % 4 = 0 and label < 3")
    rows = rows.withColumn("split", F.when(F.col("series_id") % 3 == 0, "test").when(F.col("series_id") % 3 == 1, "validate").otherwise("train"))
    f = forest.grow(rows, forest.Settings.pooled(64, words=4, intervals=4, tries=(1, 2), trees=1))
    nodes = f.nodes.collect()
    root = [n for n in nodes if n.depth == 0]
    assert len(root) == 1 and root[0].n == rows.where("split = 'train'").count()
    inner = {n.node_id for n in nodes if not n.leaf}
    for node in inner:  # a node's children share out its rows
        children = [n for n in nodes if n.node_id.rpartition("/")[0] == node]
        assert len(children) > 1 and sum(c.n for c in children) == next(n.n for n in nodes if n.node_id == node)
    assert all(n.gini == 0 or n.n > 1 for n in nodes if n.leaf)
    shape = forest.shapes(f.nodes).first()
    assert (shape.nodes, shape.leaves) == (len(nodes), len(nodes) - len(inner)) and shape.depth == max(n.depth for n in nodes)
    p = forest.predict(f, "validate")
    assert p.count() == rows.where("split = 'validate'").count()
    assert forest.predict(f, "train").where("label <> predicted").join(f.nodes.where("leaf and gini > 0"), "tree_id", "left_semi").count() == forest.predict(f, "train").where("label <> predicted").count()
    assert forest.exported_predictions(p, 1).columns[-1] == "correct"
    features = forest.export(f)
    assert features.where("infogain < 0").count() == 0
    values = forest.export_values(f, features)
    assert values.count() == features.count() * rows.count() and values.where("value is null").count() == 0


def database(folder):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


def canonical(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str([round(float(r[i]), 6) if isinstance(r[i], float) else str(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", ["series_load_stats", "znorm_sample", "paa_fractional", "sax_tfidf", "acf_interval", "sfa_bins_equi_depth", "sfa_packed", "gini",
                                  "best_word_per_class", "gini_binary_split", "stratified_folds", "bootstrap", "bag_distance", "daily_event_series", "streamed_daily_sums", "feature_distance_sax", "pacf", "ar_order"])
def test_query_equals_its_twin(spark, small, name):
    got = catalogue.QUERIES[name](spark, small)
    want = database(small).sql(oracle.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns)


def test_the_rest_works_with_the_corpus_folders_deleted(tmp_path):
    for name in ("wavelode", "tests", "__spark_entry__.py", "bench.py"):
        path = os.path.join(ROOT, name)
        if os.path.isdir(path):
            shutil.copytree(path, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(path, tmp_path / name)
    chosen = ["test_dft_of_a_known_vector", "test_paa", "test_equi_depth_bins", "test_readers_and_writers", "test_choice_of_prefix", "test_query_equals_its_twin[gini]", "test_query_equals_its_twin[sfa_packed]"]
    tests = [*[f"tests/test_series.py::{t}" for t in chosen], "tests/test_sliding.py"]
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(tmp_path), *filter(None, sys.path)])}
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *tests], cwd=tmp_path, check=True, timeout=600, env=env)
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'acf' in e.queries() and 'pipeline' not in e.queries()"], cwd=tmp_path, check=True, timeout=120, env=env)


def test_the_library_imports_without_the_corpus_operators(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('wavelode.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'acf' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
