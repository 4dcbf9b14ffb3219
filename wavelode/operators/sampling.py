"""Samples of series: uniform, by class and node, in a random order, by weight; boosting that draws by weight."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import symbols
from ..sources import ranges
from ..sources.storage import stored
from . import forest, splits

RANGES = 256
#: Whole units of a weight of 1: sums of units are exact in any order.
UNITS = 1_000_000


def smallest(rows: DataFrame, n: int, order: Column, *keys: str) -> DataFrame:
    """Of each keys' rows the n first in the given order (ties by series_id), all if there are fewer. The first of each
    of RANGES remainders of the order are found before the first of all, so no task sorts more than that of a key."""
    ranged = rows.withColumn("_o", order).withColumn("_r", F.col("_o") % RANGES)
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("_o", "series_id"))
    few = ranged.withColumn("_k", nth(*keys, "_r")).where(F.col("_k") <= n)
    whole = nth(*keys) if keys else F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_o", "series_id"))  # RANGES * n rows
    return few.withColumn("_k", whole).where(F.col("_k") <= n).drop("_o", "_r", "_k")


def uniform(rows: DataFrame, n: int, order: Column) -> DataFrame:
    """n rows of all, each as likely as another, the same ones on every run."""
    return smallest(rows, n, order)


def shuffled(rows: DataFrame, order: Column) -> DataFrame:
    """rows with position 0, 1, ... in a random order."""
    return ranges.numbered(rows.withColumn("_o", order), "position", "_o", "series_id").drop("_o")


def units(weight: Column) -> Column:
    return F.round(weight * UNITS).cast("long")


def weighted_bootstrap(rows: DataFrame, weight: Column, draws: int, seed: int) -> DataFrame:
    """(series_id, times) of `draws` draws with replacement, a row as likely as its weight says; rows drawn at least once.

    Rows lie one after another on a line, each as long as its weight; a draw is a point of the line and falls on the row
    that starts last before it. Both are sorted by range together, so there is no join of points with stretches.
    Weights count in millionths; rows without one are never drawn.
    """
    own = rows.select("series_id", units(weight).alias("w")).where("w > 0")
    line = stored(ranges.summed_before(own, "at", "w", "series_id"), "weights")
    total = line.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    if not total:
        return line.select("series_id", F.lit(0).cast("long").alias("times")).limit(0)
    share = (F.col("id") * 1103515245 + seed) % 2147483648 / 2147483648.0
    points = rows.sparkSession.range(draws).select(F.floor(share * total).cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(line.schema["series_id"].dataType).alias("own"))
    both = line.select("at", F.lit(0).alias("kind"), F.col("series_id").alias("own")).unionByName(points)
    found = ranges.filled(both, "series_id", "own", "at", "kind")
    return found.where("kind = 1").groupBy("series_id").agg(F.count("*").alias("times"))


def weighted_error(predictions: DataFrame) -> DataFrame:
    """error, the share of weight that is predicted wrongly, and total, of (label, predicted, weight); one row."""
    wrong = F.when(F.col("predicted") == F.col("label"), 0.0).otherwise(F.col("weight"))
    return predictions.agg((F.sum(wrong) / F.sum("weight")).alias("error"), F.sum("weight").alias("total"))


def stage_weight(error: float, classes: int) -> float:
    """ln((1 - error) / error) + ln(classes - 1): what a learner's vote counts; 0 for one no better than chance."""
    if error >= 1 - 1 / classes:
        return 0.0
    return math.log((1 - error) / max(error, 1e-12)) + math.log(max(classes - 1, 1))


def reweighted(predictions: DataFrame, classes: int) -> tuple[DataFrame, float, float]:
    """predictions (series_id, label, predicted, weight) with weights for the next round, and the error and vote of this
    one: wrongly predicted rows gain by the vote's exponential, and weights average 1 again."""
    row = weighted_error(predictions).first()
    if row["error"] is None:
        return predictions, 0.0, 0.0
    vote = stage_weight(row["error"], classes)
    grown = F.when(F.col("predicted") == F.col("label"), F.col("weight")).otherwise(F.col("weight") * math.exp(vote))
    after = row["total"] * (1 + row["error"] * (math.exp(vote) - 1))
    n = predictions.count()
    return predictions.withColumn("weight", grown * (n / after)), row["error"], vote


def boosted(series: DataFrame, f: forest.Settings, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(stages, votes) of trees grown one after another, each on a draw by weight, which raises what the ones before
    got wrong. stages: round, error, vote. votes: series_id, split, label, predicted, score for the series of all splits.

    A series drawn several times stands as often in the sample; bins are learned once, from all. Rounds end with a tree that is no better than chance.
    """
    spark = series.sparkSession
    train = series.where("split = 'train'").select("series_id", "label", "x")
    classes, n = train.select("label").distinct().count(), train.count()
    weights = train.select("series_id", F.lit(1.0).alias("weight"))
    cuts = symbols.learned_cuts(train, f.word_params)
    stages, votes = [], []
    for r in range(rounds):
        drawn = weighted_bootstrap(weights, F.col("weight"), n, f.seed + r)
        copies = train.join(drawn, "series_id").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
        copies = copies.select((F.col("series_id") * n + F.col("copy")).alias("series_id"), "label", "x", F.lit("train").alias("split"))
        tree = forest.grow(stored(copies, "boost-sample"), replace(f, trees=1, seed=f.seed + r), cuts)
        tree.series = series.withColumn("split", F.lit("all"))
        said = stored(forest.predict(tree, "all").select("series_id", "label", "predicted"), "boost-predictions")
        after, error, vote = reweighted(said.join(weights, "series_id"), classes)
        stages.append((r, float(error), float(vote)))
        if vote <= 0:
            break
        votes.append(said.withColumn("vote", F.lit(vote)))
        weights = stored(after.select("series_id", "weight"), "boost-weights")
    table = spark.createDataFrame(stages, "round int, error double, vote double")
    if not votes:
        return table, train.select("series_id", F.lit("").alias("split"), "label", F.col("label").alias("predicted"), F.lit(0.0).alias("score")).limit(0)
    every = votes[0]
    for v in votes[1:]:
        every = every.unionByName(v)
    scores = every.groupBy("series_id", "label", "predicted").agg(F.sum("vote").alias("score"))
    best = scores.groupBy("series_id", "label").agg(F.max_by(F.struct("predicted", "score"), F.struct("score", -F.col("predicted"))).alias("b"))
    return table, best.join(series.select("series_id", "split"), "series_id").select("series_id", "split", "label", "b.predicted", "b.score")


def sampled_splits(rows: DataFrame, keys: list[str], per_class: int, order: Column, x: str = "x") -> DataFrame:
    """(keys, attribute, threshold, sample_wgini, wgini): each node's best binary split by a sample of its rows, and what
    it is worth on all of them.

    rows: keys, series_id, label and array x. At most per_class rows of each class of a node are searched for the
    split; a scan of all rows then counts its two sides.
    """
    few = smallest(rows.select(*keys, "series_id", "label", x), per_class, order, *keys, "label")
    found = splits.gini_splits(splits.attributes(few, x, keys), keys)
    best = splits.best_of(found, keys, [F.col("attribute")]).withColumnRenamed("wgini", "sample_wgini") if keys else found.orderBy("wgini", "attribute").limit(1).withColumnRenamed("wgini", "sample_wgini")
    best = stored(best, "sampled-splits")
    met = rows.join(best, keys) if keys else rows.crossJoin(F.broadcast(best))  # one row
    value = F.round(F.element_at(x, F.col("attribute") + 1), 6) + 0.0
    sides = met.select(*keys, "label", "attribute", "threshold", "sample_wgini", (value >= F.col("threshold")).alias("far"))
    counts = sides.groupBy(*keys, "attribute", "threshold", "sample_wgini", "far", "label").agg(F.count("*").alias("c"))
    per = counts.groupBy(*keys, "attribute", "threshold", "sample_wgini", "far").agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("c")) / F.sum("c")).alias("q"))
    out = per.groupBy(*keys, "attribute", "threshold", "sample_wgini").agg((F.sum(F.col("n") - F.col("q")) / F.sum("n")).alias("wgini"))
    return out.select(*keys, "attribute", "threshold", "sample_wgini", "wgini")
