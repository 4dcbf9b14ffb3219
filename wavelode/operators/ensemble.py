"""Ensembles of word models: one model per word parameter, kept by its result on a validation split, voting with it.

A model holds a vector per class: (1 + ln tf) ln(1 + classes / classes that have the word), scaled to length one. A
series belongs to the class whose vector has the largest product with its bag of words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored


def class_vectors(words: DataFrame) -> DataFrame:
    """(param_id, word, weights: array of (label, weight)) from words (param_id, label, word). A row holds a word's
    weights in all classes, so its length is bounded by the number of classes."""
    counts = words.groupBy("param_id", "label", "word").agg(F.count("*").alias("tf"))
    by_word = stored(counts.groupBy("param_id", "word").agg(F.collect_list(F.struct("label", "tf")).alias("by")), "class-words")
    classes = words.groupBy("param_id").agg(F.count_distinct("label").alias("classes"))  # a row per parameter
    idf = F.log(1 + F.col("classes") / F.size("by"))
    weights = F.transform("by", lambda c: F.struct(c["label"].alias("label"), ((1 + F.log(c["tf"])) * idf).alias("weight")))
    rows = stored(by_word.join(F.broadcast(classes), "param_id").select("param_id", "word", weights.alias("weights")), "class-weights")
    each = rows.select("param_id", F.inline("weights"))
    lengths = each.groupBy("param_id", "label").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    maps = lengths.groupBy("param_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "length"))).alias("lengths"))
    scaled = F.transform("weights", lambda c: F.struct(c["label"].alias("label"), (c["weight"] / F.element_at("lengths", c["label"])).alias("weight")))
    return rows.join(F.broadcast(maps), "param_id").select("param_id", "word", scaled.alias("weights"))


def predictions(words: DataFrame, vectors: DataFrame, decimals: int = 9) -> DataFrame:
    """(param_id, series_id, predicted, score) of words (param_id, series_id, word): the class with the largest
    product, of equal ones the larger label. A series none of whose words a model knows has no row.

    Words are counted by series before they meet the vectors, so a word that stands everywhere is a row a series.
    """
    bags = words.groupBy("param_id", "series_id", "word").agg(F.count("*").alias("n"))
    parts = bags.join(vectors, ["param_id", "word"]).select("param_id", "series_id", "n", F.inline("weights"))
    scores = parts.groupBy("param_id", "series_id", "label").agg(F.round(F.sum(F.col("n") * F.col("weight")), decimals).alias("score"))
    best = scores.groupBy("param_id", "series_id").agg(F.max(F.struct("score", "label")).alias("best"))
    return best.select("param_id", "series_id", F.col("best.label").alias("predicted"), F.col("best.score").alias("score"))


def results(predicted: DataFrame, series: DataFrame, params: int) -> DataFrame:
    """(param_id, correct) of models 0 to params - 1 on labelled series; a missing prediction is wrong."""
    hits = predicted.join(series.select("series_id", "label"), "series_id").groupBy("param_id").agg(F.count_if(F.col("predicted") == F.col("label")).alias("correct"))
    models = predicted.sparkSession.range(params).select(F.col("id").cast("int").alias("param_id"))
    return models.join(hits, "param_id", "left").select("param_id", F.coalesce("correct", F.lit(0)).cast("long").alias("correct"))


def by_factor(models: DataFrame, factor: float = 0.92) -> DataFrame:
    """The models (param_id, correct) that have at least factor times the best one's correct answers."""
    best = models.agg(F.max("correct").alias("best"))  # one row
    return models.join(F.broadcast(best), F.col("correct") >= F.col("best") * factor).drop("best")


def vote(predicted: DataFrame, models: DataFrame, weighted: bool = True) -> DataFrame:
    """(series_id, predicted, weight, n_models): the label with the most votes of models, each worth its correct
    answers or, with weighted=False, one; of equal ones the larger label. Predictions that are null don't vote."""
    weight = F.col("correct") if weighted else F.lit(1).cast("long")
    ballots = predicted.where(F.col("predicted").isNotNull()).join(F.broadcast(models), "param_id")  # models: a row per parameter
    sums = ballots.groupBy("series_id", F.col("predicted").alias("label")).agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))
    best = sums.groupBy("series_id").agg(F.max(F.struct("weight", "label")).alias("best"), F.sum("n").alias("n_models"))
    return best.select("series_id", F.col("best.label").alias("predicted"), F.col("best.weight").alias("weight"), "n_models")
