"""Class histograms, gini, entropy and information gain over long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "label").agg(F.count("*").alias("n"))


def gini(rows: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    """(keys, n, gini): 1 minus the squared class shares, from class counts or summed weights. A set
    without rows has no row here; its gini counts as 1 (see split_gini)."""
    counts = rows.groupBy(*keys, "label").agg((F.sum(weight) if weight else F.count("*")).alias("c"))
    out = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    return out.select(*keys, "n", (1 - F.col("sq") / (F.col("n") * F.col("n"))).alias("gini"))


def split_gini(rows: DataFrame, keys: list[str], branch: str, weight: str | None = None) -> DataFrame:
    """(keys, n, branches, wgini): the branches' gini weighted by their share of the node. An empty
    branch has share 0, so that only the number of branches tells of it. weight: how much a row counts."""
    per = gini(rows, *keys, branch, weight=weight)
    out = per.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count("*").alias("branches"), F.sum(F.col("n") * F.col("gini")).alias("s")
    )
    return out.select(*keys, "n", "branches", (F.col("s") / F.col("n")).alias("wgini"))


def entropy(p: Column, n: Column) -> Column:
    """One class against the rest, natural logarithm: p of n rows are of the class."""
    part = lambda c: F.when(c > 0, -(c / n) * F.log(c / n)).otherwise(0.0)
    return F.when(n > 0, part(p) + part(n - p)).otherwise(0.0)


def gain(p_right: Column, n_right: Column, p: Column, n: Column) -> Column:
    """Information gain of a split: p_right of n_right rows on the far side, p of n in all."""
    left_n, left_p = n - n_right, p - p_right
    return entropy(p, n) - n_right / n * entropy(p_right, n_right) - left_n / n * entropy(left_p, left_n)


def best_thresholds(values: DataFrame, keys: list[str], own: Column, decimals: int = 9, count: str | None = None) -> DataFrame:
    """(keys, gain, threshold, n_class, n_class_far): the threshold that tells most of a class.

    values: keys and value; own says whether a row is of the class. Every distinct value is a candidate;
    value >= threshold is the far side. The smallest threshold of those with the largest gain (to
    `decimals`) wins; without any gain the threshold is 0. Rows are counted per distinct value before
    the window, which so holds no more of a key than it has values. count: a column of how often a row stands.
    """
    n = F.col(count) if count else F.lit(1)
    at = values.groupBy(*keys, "value").agg(F.sum(n).alias("here"), F.sum(F.when(own, n).otherwise(0)).alias("c"))
    whole = Window.partitionBy(*keys)
    line = whole.orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = at.select(
        *keys, "value", F.sum("here").over(line).alias("n_far"), F.sum("c").over(line).alias("p_far"),
        F.sum("here").over(whole).alias("n"), F.sum("c").over(whole).alias("p"),
    )
    rows = rows.withColumn("gain", F.round(gain(F.col("p_far"), F.col("n_far"), F.col("p"), F.col("n")), decimals))
    best = F.max_by(F.struct("value", "p_far"), F.struct("gain", -F.col("value")))
    out = rows.groupBy(*keys).agg(F.max("gain").alias("gain"), best.alias("b"), F.first("p").alias("n_class"))
    some = F.col("gain") > 0
    return out.select(
        *keys, F.when(some, F.col("gain")).otherwise(0.0).alias("gain"), F.when(some, F.col("b.value")).otherwise(0.0).alias("threshold"),
        "n_class", F.when(some, F.col("b.p_far")).otherwise(F.col("n_class")).alias("n_class_far"),
    )


def fixed_gain(values: DataFrame, keys: list[str], threshold: Column) -> DataFrame:
    """(keys, label, gain, far, near) at a given threshold, for every class of keys' rows."""
    side = values.groupBy(*keys, "label").agg(F.count_if(F.col("value") >= threshold).alias("far"), F.count("*").alias("p"))
    whole = Window.partitionBy(*keys)  # a row for each class: values are read once
    rows = side.withColumn("n_far", F.sum("far").over(whole)).withColumn("n", F.sum("p").over(whole))
    return rows.select(*keys, "label", gain(F.col("far"), F.col("n_far"), F.col("p"), F.col("n")).alias("gain"), "far", (F.col("p") - F.col("far")).alias("near"))


def majority(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, label): the most frequent class; of equally frequent ones the smallest."""
    counts = histogram(rows, *keys)
    return counts.groupBy(*keys).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))


def stratified_folds(rows: DataFrame, folds: int, order: Column) -> DataFrame:
    """(series_id, fold): rows of each class dealt to folds in turn, in the given order.

    A class is numbered in ranges of the order's hash: counts per range first, then places inside a
    range, so that one frequent class doesn't pass through one task's window.
    """
    ranged = rows.withColumn("o", order).withColumn("r", F.shiftright("o", 21))
    counts = ranged.groupBy("label", "r").agg(F.count("*").alias("c"))
    base = F.sum("c").over(Window.partitionBy("label").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    nth = F.row_number().over(Window.partitionBy("label", "r").orderBy("o", "series_id"))
    placed = ranged.withColumn("k", nth).join(counts.withColumn("base", base).drop("c"), ["label", "r"])
    return placed.select("series_id", "label", ((F.col("base") + F.col("k") - 1) % folds).cast("int").alias("fold"))


def bootstrap(rows: DataFrame, seed: int) -> DataFrame:
    """(series_id, label, times) of as many draws with replacement as a class has rows, each a row of it by
    a seeded hash; rows drawn at least once.

    A class's rows are numbered in ranges of ids: counts per range first, then places inside a range, so
    that one frequent class doesn't pass through one task's window.
    """
    ranged = rows.select("series_id", "label", F.floor(F.col("series_id") / 4096).alias("r"))
    counts = ranged.groupBy("label", "r").agg(F.count("*").alias("c"))
    base = F.sum("c").over(Window.partitionBy("label").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    nth = F.row_number().over(Window.partitionBy("label", "r").orderBy("series_id")) - 1
    placed = ranged.withColumn("nth", nth).join(counts.withColumn("base", base).drop("c"), ["label", "r"])
    placed = placed.join(histogram(rows), "label").select("series_id", "label", (F.col("base") + F.col("nth")).alias("k"), "n")
    drawn = (F.col("k") * 1103515245 + seed) % 2147483648 % F.col("n")
    times = placed.groupBy("label", drawn.alias("k")).agg(F.count("*").alias("times"))
    return placed.join(times, ["label", "k"]).select("series_id", "label", "times")


def stratified_sample(rows: DataFrame, per_class: int, order: Column) -> DataFrame:
    """(series_id, label): of each class the first per_class rows in the given order, all if it has fewer.

    The first of each of a class's hash ranges are found before the first of all, so that a frequent
    class doesn't pass through one task's window.
    """
    ranged = rows.select("series_id", "label", order.alias("o")).withColumn("r", F.col("o") % 256)
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("o", "series_id"))
    few = ranged.withColumn("k", nth("label", "r")).where(F.col("k") <= per_class)
    return few.withColumn("k", nth("label")).where(F.col("k") <= per_class).select("series_id", "label")
