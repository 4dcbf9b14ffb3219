"""Words as split candidates: fuzzy distances, class exemplars, best words and n-ary routing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sliding
from . import impurity


def pick(key: Column, seed: int) -> Column:
    """A seeded order of ids in portable integer arithmetic: 31 bits."""
    return (key.cast("long") * 1103515245 + seed) % 2147483648


def exemplars(series: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """(keys, label, series_id): one series of each class, the first in pick's order."""
    order = F.struct(pick(F.col("series_id"), seed), "series_id")
    return series.groupBy(*keys, "label").agg(F.min_by("series_id", order).alias("series_id"))


def query_words(words: DataFrame, chosen: DataFrame) -> DataFrame:
    """(label, word, series_id, offset): the exemplars' distinct words with their first offset."""
    rows = words.join(chosen.select("series_id"), "series_id")
    return rows.groupBy("label", "word", "series_id").agg(F.min("offset").alias("offset"))


def word_sets(words: DataFrame) -> DataFrame:
    """(param_id, series_id, label, ws): each series' different words, as many as it has windows at most."""
    return words.groupBy("param_id", "series_id", "label").agg(F.collect_set("word").alias("ws"))


def _codes(words: list[str], longest: int, alphabet: int) -> np.ndarray:
    """packed() words; those of fewer than `longest` letters end in the first letter."""
    letters = np.array([w.encode() for w in words], f"S{longest}").view(np.uint8).reshape(len(words), longest)
    return sliding.packed(np.maximum(letters.astype(np.int16) - 97, 0), alphabet)


def indexed_least(queries: np.ndarray, sets: list[list[str]], longest: int, alphabet: int, cells: int = 1 << 23) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, least distances (queries, rows)) for runs of rows: of each query to each row's words.

    The rows' words have a dictionary, so a word that many series share is compared with a query once; the rows
    only look up its distance. A run is as long as the looked-up distances fit `cells`.
    """
    at = 0
    while at < len(sets):
        upto, size = at, 0
        while upto < len(sets) and (upto == at or (size + len(sets[upto])) * len(queries) <= cells):
            size += len(sets[upto])
            upto += 1
        lens = np.array([len(s) for s in sets[at:upto]])
        known, place = np.unique(np.array([w for s in sets[at:upto] for w in s], f"U{longest}"), return_inverse=True)
        codes = _codes(known.tolist(), longest, alphabet)
        d = np.zeros((len(queries), len(known)), np.uint16)
        for c in range(codes.shape[1]):
            d += np.bitwise_count(queries[:, None, c] ^ codes[None, :, c])
        yield at, np.minimum.reduceat(d[:, place], np.cumsum(lens) - lens, axis=1)
        at = upto


def min_distances(words: DataFrame, queries: DataFrame, length: int, keys: list[str], alphabet: int = 4) -> DataFrame:
    """(param_id, keys of queries, series_id, series_label, value): least fuzzy distance of a query to a
    series' words, of every query with every series of its param_id.

    Series, a row each with their words, are dealt over the partitions of each param_id; where they stream
    through a task the queries come first, and a dictionary of the words at hand is compared with them. Only the
    result's rows, a pair of query and series, are made. A task holds one parameter's queries.
    """
    spark = words.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = [queries.schema[k] for k in keys]
    series_kinds = [words.schema[c].dataType for c in ("series_id", "label")]
    schema = T.StructType([T.StructField("param_id", T.IntegerType()), *kinds, T.StructField("series_id", series_kinds[0]), T.StructField("series_label", series_kinds[1]), T.StructField("value", T.IntegerType())])

    def run(batches):
        key, heads, codes = None, [], None
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            spots = list(zip(column["param_id"].to_pylist(), column["salt"].to_pylist(), column["kind"].to_pylist(), strict=True))
            edges = [0, *[i for i in range(1, len(spots)) if spots[i] != spots[i - 1]], len(spots)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                own = batch.slice(a, b - a)
                of = lambda c: own.column(own.schema.names.index(c))  # noqa: B023, E731
                if spots[a][2] == 0:
                    if spots[a][:2] != key:
                        key, heads = spots[a][:2], []
                    heads.append(own)
                    codes = None
                    continue
                if spots[a][:2] != key:
                    continue
                if codes is None:
                    table = pa.Table.from_batches(heads)
                    asked = table.column("q").to_pylist()
                    fields = [table.column("keys").combine_chunks().field(i) for i in range(len(keys))]
                    codes = _codes(asked, length, alphabet)
                for at, d in indexed_least(codes, of("ws").to_pylist(), length, alphabet):
                    n, m = d.shape
                    place = pa.array(np.repeat(np.arange(n), m))
                    rows = pa.array(np.tile(np.arange(at, at + m), n))
                    columns = [pa.repeat(pa.scalar(key[0], pa.int32()), n * m), *[f.take(place) for f in fields], of("series_id").take(rows), of("label").take(rows), pa.array(d.reshape(-1).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    none = lambda t: F.lit(None).cast(t)
    asked = F.struct(*keys)
    heads = queries.select(F.col("param_id").cast("int").alias("param_id"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), asked.alias("keys"), F.col("word").alias("q"),
                           none(series_kinds[0]).alias("series_id"), none(series_kinds[1]).alias("label"), none("array<string>").alias("ws"))
    body = word_sets(words).select(F.col("param_id").cast("int").alias("param_id"), F.pmod(F.xxhash64("series_id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), none(heads.schema["keys"].dataType).alias("keys"),
                                   none("string").alias("q"), "series_id", "label", "ws")
    line = heads.unionByName(body).repartition("param_id", "salt").sortWithinPartitions("param_id", "salt", "kind")
    return line.mapInArrow(run, schema)


def scored_words(distances: DataFrame, keys: list[str]) -> DataFrame:
    """(keys with label, gain, threshold, valid): each query word's best threshold for its own class,
    and whether at least as many rows of the class lie below it as above (then it is usable)."""
    best = impurity.best_thresholds(distances, keys, F.col("series_label") == F.col("label"))
    valid = (F.col("gain") > 0) & (F.col("n_class_far") * 2 <= F.col("n_class"))
    return best.withColumn("valid", valid).drop("n_class", "n_class_far")


def best_words(scored: DataFrame, keys: list[str], top: int = 1) -> DataFrame:
    """Of each keys' valid words the `top` with the largest gain, ties by offset and word."""
    order = Window.partitionBy(*keys).orderBy(F.col("gain").desc(), "offset", "word")
    return scored.where("valid").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top)


def route(distances: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, series_id, series_label, branch): among classes whose distance is below their threshold the
    one with the largest gain, else the one that comes nearest; ties go to the smaller label.

    distances: keys, series_id, series_label, label, value, threshold, gain, a row per class."""
    inside = F.col("value") < F.col("threshold")
    order = F.struct(
        (~inside).cast("int"), F.when(inside, -F.col("gain")).otherwise(F.col("value") - F.col("threshold")), F.col("label")
    )
    return distances.groupBy(*keys, "series_id", "series_label").agg(F.min_by("label", order).alias("branch"))
